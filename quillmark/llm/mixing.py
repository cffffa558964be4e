"""Mixing sources to target weights.

Tokens are added up per source, the sources' targets follow from their weights, and a source's rate
is target / tokens. A document is emitted floor(rate) times, plus one copy if its hash falls below
the rate's fraction (a Bernoulli draw seeded by the hash, so reruns agree). The hash is of the id and the text;
rows that are equal in both are numbered by a digest of all their columns, and the hash has this number too, so that they are
drawn apart, however the table's files are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, ranked, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = "mix"
#: Source names and targets up to this many bytes are sent to all executors; more are joined by key.
BROADCAST_BYTES = 4 << 20


def draw(doc_id: Column, text: Column, place: Column) -> Column:
    """A number in [0, 1) from an MD5 digest (52 bits, exact as a double)."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), place.cast("string"), F.lit(SEED)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _numbered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with ``nth``, their number by code point, null last: numbered in ranges, so that no task holds all."""
    parts = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").asc_nulls_last())
    parts = scratch.table(parts.withColumn("id", F.monotonically_increasing_id()))
    pieces = parts.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    pieces = pieces.select("part", F.coalesce(first, F.lit(0)).alias("first"))
    nth = F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1)
    return parts.join(F.broadcast(pieces), F.shiftright("id", 33) == F.col("part")).select("source", "source_size", nth.alias("nth"))


def source_targets(sizes: DataFrame, scratch: Scratch, share: float = SHARE, weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target``: targets by weight, none above ``most`` times its size.

    ``sizes`` has source and size. Weights repeat over the sources by code point, null last. A source whose part
    by weight is above its bound gets the bound and leaves the rest to the others, until none is above; each
    round is one aggregate over the sources.
    """
    per = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    per = scratch.table(per.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap")))
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("w") * level if capped >= 0 else F.lit(False)
        row = per.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("used"), F.sum(F.when(~above, F.col("w"))).alias("free")).first()
        if row["n"] == capped or not row["free"]:
            break
        capped, level = row["n"], (total - (row["used"] or 0.0)) / row["free"]
    return per.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``row`` (the row of ``docs``, with columns of any name), ``size, source_size, target, copies``.

    Sizes of null texts are 0. A source of size 0 has target 0 and none of its documents is taken; a null source
    is a source. Rows with one id but other texts, null ids included, are drawn apart, and so are rows equal in
    both, by their numbers. A table without rows gives none. Texts of any length count whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"), F.col(source).alias("source"), key.alias("key"))
    thin = scratch.table(sized.select("source", "size", "key"))
    targets = scratch.table(source_targets(thin, scratch))
    right = targets.select(F.col("source").alias("_s"), "source_size", "target")
    if (targets.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    repeated = Bitmap(thin.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key")
    # The filter lets some rows pass that have no equal: these are number 0 like the rows it holds back.
    sized = sized.withColumn("again", repeated.may_hold(F.col("key")))
    equal = sized.where("again").select("row", "size", "source", "key", F.xxhash64(F.to_json("row")).alias("digest"))
    equal = ranked(equal, ["key"], ["digest"], scratch).select("row", "size", "source", F.col("rank").alias("place"))
    sized = sized.where("not again").select("row", "size", "source", F.lit(0).cast("long").alias("place")).union(equal)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("long")
    copies = whole + (draw(F.col(f"row.`{doc_id}`"), F.col(f"row.`{text}`"), F.col("place")) < rate - whole).cast("long")
    joined = sized.join(right, F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs, word_count(F.col("text")))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, under all its columns."""
    out = mix(docs, word_count(F.col("text"))).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s
), o AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM w
), l AS (
  SELECT *, (total - cap_before) / w_left AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN cap <= level * w THEN cap
    ELSE w * (SELECT arg_min(level, k) FROM l WHERE cap > level * w) END AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, '')) || ':0:mix'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
