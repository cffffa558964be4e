"""The node table and the relations on it.

A relation parses each document once: leaf blocks carry their text and table rows their cells, so most relations
are filters of the node table; the rest take one window or aggregation on the document's key, never a join of the
table with itself. Nothing is sorted globally, and only one document's nodes of one kind have to meet in a task.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import for_kernel, heading_slug, md_nodes_array, md_to_html_each, reassembled, route
from ..kernel.tree import LEAVES
from ..options import Options


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "text", options: Options = Options(), types: Collection[str] | None = None, inline: bool = True, positions: bool = False) -> DataFrame:
    """``key`` and one row per node. A null text has no nodes, an empty one a root only."""
    tree = md_nodes_array(F.col(text), options, types, inline, positions)
    return docs.select(F.col(key), F.explode(tree).alias("_n")).select(key, "_n.*")


def render_html(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``html``: plain parts of documents in the JVM, the others by the kernel, in one scan (null: null)."""
    routed = docs.select(F.col(key), route(F.col(text)).alias("_s"))
    seen = routed.withColumn("_h", md_to_html_each(for_kernel(F.col("_s"))))
    return seen.select(key, reassembled(F.col("_s"), F.col("_h")).alias("html"))


def routing(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, kernel_chars``: how much of each document :func:`render_html` takes to Python (null texts: 0)."""
    segments = route(F.coalesce(F.col(text), F.lit("")))
    sent = F.aggregate(for_kernel(segments), F.lit(0).cast("long"), lambda n, s: n + F.length(s))
    return docs.select(F.col(key), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), sent.alias("kernel_chars"))


def leaf_text(tree: DataFrame, key: str = "doc_id", types: Collection[str] = LEAVES) -> DataFrame:
    """``key, node_id, type, text``: the text in each leaf block (a break is a line end)."""
    return tree.where(F.col("type").isin(*types)).select(key, "node_id", "type", "text")


def outline(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, node_id, depth, text`` of headings."""
    return tree.where("type = 'heading'").select(key, "node_id", "depth", "text")


def heading_slugs(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`outline` with ``slug``: repeats of a document's slug get -1, -2 and so on."""
    rows = outline(tree, key).withColumn("_base", heading_slug(F.col("text")))
    nth = F.row_number().over(Window.partitionBy(key, "_base").orderBy("node_id")) - 1
    return rows.withColumn("slug", F.when(nth == 0, F.col("_base")).otherwise(F.concat_ws("-", "_base", nth.cast("string")))).drop("_base")


def definitions(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, identifier, url, title``: of a label's definitions the first one holds."""
    first = F.min_by(F.struct("url", "title"), "node_id").alias("_d")
    return tree.where("type = 'definition'").groupBy(key, "identifier").agg(first).select(key, "identifier", "_d.url", "_d.title")


def _with_targets(tree: DataFrame, key: str, types: Collection[str]) -> DataFrame:
    """Nodes of the types with ``_d``, the first definition (url, title) of their identifier in the document."""
    rows = tree.where(F.col("type").isin("definition", *types))
    within = Window.partitionBy(key, "identifier").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    defined = F.first(F.when(F.col("type") == "definition", F.struct("url", "title")), ignorenulls=True).over(within)
    return rows.withColumn("_d", defined).where("type <> 'definition'")


def resolve_references(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, node_id, type, identifier, url, title`` of reference links and images."""
    refs = _with_targets(tree, key, ("linkReference", "imageReference"))
    return refs.select(key, "node_id", "type", "identifier", "_d.url", "_d.title")


def links(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, node_id, type, url, title`` of links and images, references resolved."""
    rows = _with_targets(tree, key, ("link", "image", "linkReference", "imageReference"))
    direct = F.col("type").isin("link", "image")
    return rows.select(key, "node_id", "type", *(F.when(direct, F.col(c)).otherwise(F.col(f"_d.{c}")).alias(c) for c in ("url", "title")))


def footnotes(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, identifier, number, n_references`` of every definition; both are null where nothing refers to it.

    Numbers follow the first references outside of definitions.
    """
    spans = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    shown = tree.where("type in ('footnoteDefinition', 'footnoteReference')").select(key, "node_id", "type", "subtree_end", "identifier")
    covered = F.max(F.when(F.col("type") == "footnoteDefinition", F.col("subtree_end"))).over(spans)
    outside = (F.col("type") == "footnoteReference") & ~F.coalesce(F.col("_covered") >= F.col("node_id"), F.lit(False))
    rows = shown.withColumn("_covered", covered).groupBy(key, "identifier").agg(
        F.bool_or(F.col("type") == "footnoteDefinition").alias("_defined"), F.nullif(F.count_if(outside), F.lit(0)).alias("n_references"),
        F.min(F.when(outside, F.col("node_id"))).alias("_first"),
    ).where("_defined")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_first").asc_nulls_last()))
    return rows.select(key, "identifier", F.when(F.col("_first").isNotNull(), nth).alias("number"), "n_references")


def used_footnotes(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, identifier`` of the footnote definitions that a reference outside of definitions needs."""
    return footnotes(tree, key).where("number is not null").select(key, "identifier")


def table_cells(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, table_id, row, column, align, text``: every cell of the tables, row 0 being the head.

    Rows are padded or cut to the head's width, as in HTML.
    """
    rows = tree.where("type = 'tableRow'").select(key, F.col("parent_id").alias("table_id"), F.col("ordinal").alias("row"), F.posexplode(F.arrays_zip("align", "cells")).alias("column", "_c"))
    return rows.select(key, "table_id", "row", "column", "_c.align", F.col("_c.cells").alias("text"))


def tasks(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, node_id, checked, text`` of task items."""
    return tree.where("type = 'listItem' and checked is not null").select(key, "node_id", "checked", "text")


def code_blocks(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    return tree.where("type = 'code'").select(key, "node_id", "lang", "meta", "value")


def inside(tree: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """The nodes below any node of a type, by a running window: a node is inside while the last such subtree goes on."""
    before = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("type") == kind, F.col("subtree_end"))).over(before)
    return tree.withColumn("_last", last).where("node_id <= _last").drop("_last")


def node_counts(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    return tree.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes"))
