"""Shortcodes of a dictionary in the texts of a node table, by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dictionary up to this size is sent to all executors; a larger one is joined by name.
BROADCAST_BYTES = 8 << 20


def replace_shortcodes(tree: DataFrame, names: DataFrame, key: str = "doc_id", name: Column | None = None, symbol: Column | None = None) -> DataFrame:
    """``tree`` with every ``:name:`` in a text's ``value`` replaced that ``names`` (name, symbol) knows; code, links' targets and raw HTML stay.

    A text is cut at its colons; what stands between two of them is looked up, from left to right, and a colon ends one
    shortcode or begins the next, not both. Names are told apart by case; of equal names the least symbol holds. Only texts with two colons or more are
    cut; a text's pieces meet again under its node. Trees with null or repeated keys must be numbered apart before.
    """
    names = names.select((F.col("name") if name is None else name).alias("_name"), (F.col("symbol") if symbol is None else symbol).alias("_symbol"))
    names = names.where("_name <> ''").groupBy("_name").agg(F.min("_symbol").alias("_symbol"))
    size = names.agg(F.sum(F.octet_length("_name") + F.octet_length(F.coalesce("_symbol", F.lit(""))) + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        names = F.broadcast(names)
    others = [c for c in tree.columns if c not in (key, "node_id", "value")]
    pieces = F.split("value", ":", -1)
    cut = (F.col("type") == "text") & (F.size(pieces) > 2)
    rows = tree.select(key, "node_id", F.struct(*others).alias("_row"), F.when(cut, F.size(pieces) - 1).alias("_last"), F.posexplode(F.when(cut, pieces).otherwise(F.array("value"))).alias("_at", "_piece"))
    inner = (F.col("_at") > 0) & (F.col("_at") < F.col("_last"))
    rows = rows.withColumn("_asked", F.when(inner & (F.col("_piece") != ""), F.col("_piece"))).join(names, F.col("_asked") == F.col("_name"), "left")
    node = Window.partitionBy(key, "node_id")
    order = node.orderBy("_at")
    # Known pieces next to each other share colons: the first, third, fifth ... of such a run are replaced.
    known = F.col("_symbol").isNotNull()
    rows = rows.withColumn("_before", F.max(F.when(~known, F.col("_at"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_new", known & ((F.col("_at") - F.coalesce("_before", F.lit(-1))) % 2 == 1))
    colon = (F.col("_at") > 0) & ~F.col("_new") & ~F.coalesce(F.lag("_new").over(order), F.lit(False))
    rows = rows.withColumn("_text", F.when(F.col("_new"), F.col("_symbol")).otherwise(F.concat(F.when(colon, ":").otherwise(""), "_piece")))
    whole = rows.groupBy(key, "node_id").agg(
        F.first("_row").alias("_row"), F.max("_last").alias("_last"), F.first("_piece").alias("_only"), F.array_sort(F.collect_list(F.when(F.col("_last").isNotNull(), F.struct("_at", "_text")))).alias("_parts"))
    value = F.when(F.col("_last").isNotNull(), F.array_join(F.transform("_parts", lambda p: p["_text"]), "")).otherwise(F.col("_only"))
    return whole.select(key, "node_id", "_row.*", value.alias("value")).select(tree.columns)
