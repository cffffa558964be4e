"""Ancestors, and edits of the tree, as single passes over rows sorted by document and place.

A document's nodes are intervals (``node_id`` to ``subtree_end``) that are nested or apart, so in order of ``node_id`` a stack of
the open ones answers what encloses a node; rows of all columns pass through, and no document is collected. Each
operator takes one exchange by document, none where a window has laid its rows by document, and reads its table once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task hands over at once where a node has many ancestors.
_BATCH_ROWS = 1 << 16


def values(column: pa.Array) -> list:
    """``to_pylist`` by way of numpy, which makes text, numbers and truth values at a fraction of a scalar each; other types as they are."""
    if column.null_count == len(column):
        return [None] * len(column)
    kind = column.type
    if pa.types.is_integer(kind) and column.null_count:
        known = column.is_valid().to_numpy(zero_copy_only=False).tolist()
        return [v if k else None for v, k in zip(column.fill_null(0).to_numpy(zero_copy_only=False).tolist(), known)]
    if pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_boolean(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _by_document(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """``rows`` with ``_nth``, their number in the document from 1, in this order. The window asks for an exchange only where rows don't lie by document."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def _pass(rows: DataFrame, key: str, inputs: list[str], outputs: dict[str, str], start: Callable[[], Callable]) -> DataFrame:
    """``rows`` (sorted within their partitions) with columns that a function of ``_nth`` and ``inputs`` gives, a batch's lists at a time; ``start`` makes one for each task.

    Only the inputs and ``_nth`` go to Python, as an iterator over a partition's batches, which keeps its state: a document begins where ``_nth``
    is 1. The other columns wait in the JVM. As the order matters, the function counts as not deterministic, so no sort below it is dropped.
    """
    kinds = pa.struct([(n, {"int": pa.int32(), "string": pa.string()}[k]) for n, k in outputs.items()])

    def tree_pass(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        step = start()
        for columns in batches:
            found = step(*(values(c) for c in columns))
            yield pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(found, kinds)], fields=list(kinds))

    schema = "struct<" + ", ".join(f"`{n}`: {k}" for n, k in outputs.items()) + ">"
    state = F.arrow_udf(tree_pass, schema).asNondeterministic()
    made = rows.withColumn("_made", state("_nth", *[F.col(f"`{c}`") for c in inputs]))
    return made.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_nth"], "_made.*")


def nearest_ancestor(tree: DataFrame, ancestors: Column, key: str = "doc_id", name: str = "ancestor_id", carried: dict[str, str] | None = None) -> DataFrame:
    """``tree`` with ``ancestor_id``: the nearest node above for which ``ancestors`` holds (none: null).

    Linear in the rows, however deep they are nested. The table may be a part of a tree, as ``nodes`` with types gives it. ``carried`` has
    names of further columns, each with a string column of the tree whose value at that ancestor it takes: what a join by ``ancestor_id`` would give.
    """
    carried = carried or {}

    def start():
        ends: list[int] = []
        above: list[tuple] = []
        none = (None,) * (1 + len(carried))

        def step(nth, number, last, opens, *more):
            found = []
            for first, n, end, open_, *told in zip(nth, number, last, opens, *more):
                if first == 1:
                    ends.clear()
                    above.clear()
                while ends and ends[-1] < n:
                    ends.pop()
                    above.pop()
                found.append(above[-1] if above else none)
                if open_:
                    ends.append(end)
                    above.append((n, *told))
            return zip(*found) if found else [()] * len(none)

        return step

    rows = _by_document(tree.withColumn("_opens", F.coalesce(ancestors, F.lit(False))), key, F.col("node_id"))
    return _pass(rows, key, ["node_id", "subtree_end", "_opens", *carried.values()], {name: "int"} | {n: "string" for n in carried}, start).drop("_opens")


def all_ancestors(tree: DataFrame, ancestors: Column, key: str = "doc_id", name: str = "ancestor_id") -> DataFrame:
    """A row of ``tree`` for each node above for which ``ancestors`` holds, with its ``ancestor_id``; linear in the result."""

    def tree_pass(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        above: list[tuple[int, int]] = []
        for columns in batches:
            offsets, found = [0], []
            for nth, number, last, opens in zip(*(values(c) for c in columns)):
                if nth == 1:
                    above = []
                while above and above[-1][1] < number:
                    above.pop()
                found += [a for a, _ in above]
                offsets.append(len(found))
                if opens:
                    above.append((number, last))
                if len(found) >= _BATCH_ROWS:
                    yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))
                    offsets, found = [0], []
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))

    rows = _by_document(tree.withColumn("_opens", F.coalesce(ancestors, F.lit(False))), key, F.col("node_id"))
    listed = F.arrow_udf(tree_pass, "array<int>").asNondeterministic()("_nth", "node_id", "subtree_end", "_opens")
    return rows.withColumn("_above", listed).select(*tree.columns, F.explode("_above").alias(name))


def descendants(tree: DataFrame, ancestors: DataFrame, key: str = "doc_id") -> DataFrame:
    """The nodes below each of ``ancestors`` (rows of the same table), with ``ancestor_id``."""
    chosen = ancestors.select(F.col(key).alias("_key"), F.col("node_id").alias("_node")).distinct().withColumn("_chosen", F.lit(True))
    flagged = tree.join(chosen, F.col(key).eqNullSafe(F.col("_key")) & (F.col("node_id") == F.col("_node")), "left").drop("_key", "_node")
    return all_ancestors(flagged, F.col("_chosen"), key).drop("_chosen")


def renumber(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """``rows`` as a tree again: ``node_id``, ``parent_id``, ``ordinal`` and ``subtree_end`` follow from the order and ``depth_in_tree``.

    A node's number is its place in the order. Forwards a stack gives its parent; backwards, the next node that is no deeper ends its subtree. What nobody
    reads of these Spark leaves out, with its pass.
    """

    def forwards():
        above: list[list[int]] = []  # depth, number, children so far

        def step(nth, depths):
            parents, ordinals = [], []
            for first, depth in zip(nth, depths):
                if first == 1:
                    above.clear()
                while above and above[-1][0] >= depth:
                    above.pop()
                if above:
                    up = above[-1]
                    parents.append(up[1])
                    ordinals.append(up[2])
                    up[2] += 1
                else:
                    parents.append(None)
                    ordinals.append(0)
                above.append([depth, first - 1, 0])
            return parents, ordinals

        return step

    def backwards():
        after: list[tuple[int, int]] = []
        end = 0

        def step(back, depths, places):
            nonlocal end
            ends = []
            for first, depth, place in zip(back, depths, places):
                if first == 1:
                    end = place - 1
                    after.clear()
                while after and after[-1][0] > depth:
                    after.pop()
                ends.append(after[-1][1] - 1 if after else end)
                after.append((depth, place - 1))
            return (ends,)

        return step

    old = ("node_id", "parent_id", "ordinal", "subtree_end")
    columns = rows.columns
    rows = _by_document(rows, key, *order)
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_nth").desc()))
    rows = _pass(rows.withColumns({"_new_place": F.col("_nth"), "_nth": back}), key, ["depth_in_tree", "_new_place"], {"_new_end": "int"}, backwards).withColumnRenamed("_new_place", "_nth")
    # Where nobody asks for the ends of subtrees, rows still lie in this order, and Spark leaves the sort out.
    rows = rows.sortWithinPartitions(key, *order).withColumn("_new_id", F.col("_nth") - 1)
    rows = _pass(rows, key, ["depth_in_tree"], {"_new_parent": "int", "_new_ordinal": "int"}, forwards)
    new = dict(zip(old, ("_new_id", "_new_parent", "_new_ordinal", "_new_end")))
    return rows.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in columns if not c.startswith("_")])


def drop_subtrees(tree: DataFrame, condition: Column, key: str = "doc_id", numbered: bool = True) -> DataFrame:
    """``tree`` without the nodes for which ``condition`` holds and all below them, numbered anew. A root that goes takes its document along.

    Without ``numbered`` nodes keep their numbers, with gaps, and ``subtree_end`` and ``ordinal`` as they were: enough for other edits and for HTML
    and JSON, and no pass is needed.
    """
    before = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max(F.when(condition, F.col("subtree_end"))).over(before)
    kept = tree.withColumn("_gone", gone).where("_gone is null or node_id > _gone")
    if not numbered:
        return kept.select(*[F.col(f"`{c}`") for c in tree.columns if not c.startswith("_")])
    return renumber(kept, key, F.col("node_id"))


def unwrap(tree: DataFrame, condition: Column, key: str = "doc_id") -> DataFrame:
    """``tree`` without the nodes for which ``condition`` holds; what is below them moves up to where they were."""
    flagged = tree.withColumn("_opens", F.coalesce(condition, F.lit(False)))

    def start():
        above: list[int] = []

        def step(nth, number, last, opens):
            found = []
            for first, n, end, open_ in zip(nth, number, last, opens):
                if first == 1:
                    above.clear()
                while above and above[-1] < n:
                    above.pop()
                found.append(len(above))
                if open_:
                    above.append(end)
            return (found,)

        return step

    rows = _pass(_by_document(flagged, key, F.col("node_id")), key, ["node_id", "subtree_end", "_opens"], {"_up": "int"}, start)
    return renumber(rows.where("not _opens").withColumn("depth_in_tree", F.col("depth_in_tree") - F.col("_up")), key, F.col("node_id"))


#: Where a fragment goes, seen from its anchor, in the order of fragments that come to the same place and depth.
PLACES = ("first", "after", "last", "before")


def insert_subtrees(tree: DataFrame, fragments: DataFrame, key: str = "doc_id") -> DataFrame:
    """``tree`` with ``fragments`` in it, numbered anew.

    A fragment is one subtree, in rows of ``key``, ``anchor`` (a ``node_id`` of the tree), ``place`` (``before`` or ``after`` the anchor,
    or as the ``first`` or ``last`` of its children), ``nth`` (tells the fragments of one place apart and orders them), and nodes with ``node_id``
    and ``depth_in_tree`` of their own, the subtree's root having 0; columns it lacks are null. A fragment
    whose anchor isn't there is left out. Anchors refer to the tree as it was, so all fragments go in at once.
    """
    own = [c for c in tree.columns if c not in (key, "node_id", "depth_in_tree")]
    kinds = dict(tree.dtypes)
    add = fragments.select(key, F.col("anchor").alias("_anchor"), "place", F.col("nth").cast("long").alias("_turn"), "node_id", "depth_in_tree",
                           *[F.col(c) if c in fragments.columns and c not in ("subtree_end", "parent_id") else F.lit(None).cast(kinds[c]).alias(c) for c in own])
    old = tree.select(key, F.col("node_id").alias("_anchor"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("long").alias("_turn"), "node_id", "depth_in_tree", *own)
    # Both sides are laid by document, where they don't lie so already: by document and anchor they would have to be laid twice.
    n = max(tree.sparkSession.sparkContext.defaultParallelism, int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = old.repartition(n, key).unionByName(add.repartition(n, key))
    # A fragment meets its anchor under the anchor's number.
    at = Window.partitionBy(key, "_anchor")
    real = F.col("place").isNull()
    both = both.withColumns({"_depth": F.max(F.when(real, F.col("depth_in_tree"))).over(at), "_end": F.max(F.when(real, F.col("subtree_end"))).over(at)}).where("_depth is not null")
    place = F.col("place")
    point = F.when(real | (place == "before"), F.col("_anchor")).when(place == "first", F.col("_anchor") + 1).otherwise(F.col("_end") + 1)
    depth = F.when(real, F.col("_depth")).otherwise(F.col("_depth") + F.when(place.isin("first", "last"), 1).otherwise(0) + F.col("depth_in_tree"))
    root_depth = depth - F.when(real, F.lit(0)).otherwise(F.col("depth_in_tree"))
    rank = F.array_position(F.array(*[F.lit(p) for p in PLACES]), place)
    both = both.withColumns({"_point": point, "_late": real, "_level": -root_depth, "_rank": rank, "_own": F.col("node_id"), "depth_in_tree": depth})
    order = ["_point", "_late", "_level", "_rank", "_turn", "_own"]
    return renumber(both.drop("place"), key, *[F.col(c) for c in order]).select(tree.columns)
