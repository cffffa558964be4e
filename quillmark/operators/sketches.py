"""Mergeable sketches of node rows: counts, distinct contents, lengths and most frequent values, without a second parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of a distinct sketch's registers: standard error 1.04 / sqrt(2 ** LG_K), 1.6%.
LG_K = 12
#: Size of a quantile sketch: rank error about 1.7% at 200.
KLL_K = 200
#: Values that a frequency sketch tracks; counts are exact while no more differ.
TRACKED = 10_000
QUANTILES = (0.5, 0.9, 0.99)


def _content() -> Column:
    """What counts as a node's value: the address of a link, image or definition, else its text, else its own value."""
    return F.coalesce("url", "text", "value")


def sketch_nodes(tree: DataFrame, by: Sequence[str], lg_k: int = LG_K, kll_k: int = KLL_K, tracked: int = TRACKED) -> DataFrame:
    """One row per ``by`` and node ``type`` to be stored: ``n_nodes`` (exact) and sketches ``distinct_values``, ``lengths`` and ``frequent``.

    ``tree`` has node rows and the columns ``by`` (a source, a day). Nodes without content (a list, a break) count in ``n_nodes``
    alone. Partial sketches are made before the exchange, so a hot group costs no more than its sketch.
    """
    rows = tree.select(*by, "type", _content().alias("_v"))
    return rows.groupBy(*by, "type").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.hll_sketch_agg("_v", lg_k).alias("distinct_values"),
        F.kll_sketch_agg_bigint(F.length("_v").cast("long"), kll_k).alias("lengths"),
        F.call_function("approx_top_k_accumulate", F.col("_v"), F.lit(tracked)).alias("frequent"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of :func:`sketch_nodes`, of one or many tables, as one row per ``by`` (some of their columns) and type."""
    return sketches.groupBy(*by, "type").agg(
        F.sum("n_nodes").alias("n_nodes"),
        F.hll_union_agg("distinct_values").alias("distinct_values"),
        F.kll_merge_agg_bigint("lengths").alias("lengths"),
        F.call_function("approx_top_k_combine", F.col("frequent")).alias("frequent"),
    )


def estimates(sketches: DataFrame, top: int = 5, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """What sketches say: ``n_nodes``, ``n_values`` (nodes with content, exact), ``n_distinct``, ``length_quantiles`` (null without content), ``most_frequent`` (value and count, descending)."""
    n = F.kll_sketch_get_n_bigint("lengths")
    known = F.kll_sketch_get_quantile_bigint(F.col("lengths"), F.array(*(F.lit(q) for q in quantiles)))
    keys = [c for c in sketches.columns if c not in ("n_nodes", "distinct_values", "lengths", "frequent")]
    return sketches.select(
        *keys, "n_nodes", n.alias("n_values"), F.hll_sketch_estimate("distinct_values").alias("n_distinct"),
        F.when(n > 0, known).alias("length_quantiles"),
        F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(top)).alias("most_frequent"),
    )
