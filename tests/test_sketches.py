"""Stored sketches, merged over days, against exact counts within their bounds."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import estimates, merge_sketches, nodes, sketch_nodes


@pytest.fixture(scope="module")
def tree(spark):
    n = F.col("id")
    text = F.concat(F.lit("# Title "), (n % 700).cast("string"), F.lit("\n\n"), F.repeat(F.lit("x"), (n % 97).cast("int")), F.lit(" y\n\n[l](/u"), F.when(n % 3 == 0, "hot").otherwise(n.cast("string")), F.lit(")\n\n---\n"))
    docs = spark.range(9000).select(n.alias("doc_id"), text.alias("text"))
    rows = nodes(docs).withColumn("day", F.pmod("doc_id", F.lit(5))).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a"))
    return rows.cache()


def test_merged_days_are_within_their_bounds(spark, tree, tmp_path):
    for day in range(5):
        sketch_nodes(tree.where(F.col("day") == day), ["day", "source"]).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    found = {(r.source, r.type): r for r in estimates(merge_sketches(stored, ["source"])).collect()}
    value = F.coalesce("url", "text", "value")
    exact = tree.groupBy("source", "type").agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("values"), F.countDistinct(value).alias("d"), F.sort_array(F.collect_list(F.length(value))).alias("lengths"))
    rows = exact.collect()
    assert len(rows) == len(found) and {r.source for r in rows} == {None, "a"}
    for r in rows:
        got = found[r.source, r.type]
        assert (got.n_nodes, got.n_values) == (r.n, r["values"])
        assert abs(got.n_distinct - r.d) <= 5 * 1.04 / 64 * r.d
        if not r.lengths:
            assert got.length_quantiles is None
            continue
        for q, x in zip((0.5, 0.9, 0.99), got.length_quantiles):
            below, upto = sum(v < x for v in r.lengths) / len(r.lengths), sum(v <= x for v in r.lengths) / len(r.lengths)
            assert below - 0.04 <= q <= upto + 0.04
    for source in (None, "a"):
        top = found[source, "link"].most_frequent[0]
        assert (top[0], top[1]) == ("/uhot", 1500)


def test_one_total_without_keys(tree):
    total = {r.type: r for r in estimates(merge_sketches(sketch_nodes(tree, ["day"])), top=1).collect()}
    assert total["heading"].n_nodes == 9000 and abs(total["heading"].n_distinct - 700) <= 35
    assert total["thematicBreak"].n_values == 0 and total["thematicBreak"].n_distinct == 0 and total["thematicBreak"].length_quantiles is None
