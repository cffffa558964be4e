"""Sharding by histogram sort.

Rows are ordered by a digest of their text (then of their id), so equal texts stand together. Exact
bytes and rows below candidate boundaries are counted across all partitions, and only the bins that
still hold a wanted splitter are counted anew, finer, until every splitter meets the tolerance. Then
rows are exchanged once, by range of shard and key; a shard is spread over as many tasks as it needs, and
the rows of each task's piece give the piece's first slot, so numbering never needs a whole shard in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 16
#: How far the bytes below a splitter may be from their share, as a part of a shard's bytes.
TOLERANCE = 0.002
#: The same for a splitter that would part a group of equal texts: it goes to the group's nearer end, if that is no farther.
GROUP_TOLERANCE = 0.01
#: Bins that one round counts at most (and 2 for each splitter still open, if that is more).
ROUND_BINS = 1 << 16
_PART_BITS = 33  # of monotonically_increasing_id, for a row's number in its partition
_SIGN = -(1 << 63)


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def sort_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two signed 64-bit keys: of the text, and of the id for rows with equal texts."""
    return F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(-1).cast("long")))


def _prefix(bits: int) -> tuple[Column, Column]:
    """The first ``bits`` bits of the 128-bit key, as two numbers (the second: beyond 64 bits)."""
    high, low = F.col("_k1").bitwiseXOR(F.lit(_SIGN)), F.col("_k2").bitwiseXOR(F.lit(_SIGN))
    first = F.shiftrightunsigned(high, 64 - bits) if 0 < bits < 64 else high
    second = F.lit(0).cast("long") if bits <= 64 else F.shiftrightunsigned(low, 128 - bits) if bits < 128 else low
    return first.alias("p1"), second.alias("p2")


def find_splitters(keyed: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """For each of ``parts - 1`` boundaries: the 128-bit key it stands at, and the rows below it.

    ``keyed`` has _k1, _k2, _size. A boundary stands within a group of equal texts only if both ends of the group are
    farther than GROUP_TOLERANCE of a shard and than the largest row is long (rows aren't parted, so shards differ by as much anyway);
    rows with one id and text can't be parted.
    """
    unsigned = lambda v: v & ((1 << 64) - 1)
    found: dict[int, tuple[int, int]] = {}
    bits, step = 0, ROUND_BINS.bit_length() - 1
    base = {0: (0, 0)}  # the bins to be counted, by prefix: bytes and rows below each
    wanted: dict[int, list[int]] = {0: list(range(1, parts))}
    total = None
    while wanted and bits < 128:
        more = min(step, (64 if bits < 64 else 128) - bits)
        p1, p2 = _prefix(bits + more)
        rows = keyed
        if bits:
            q1, q2 = _prefix(bits)
            pairs = [(p >> max(0, bits - 64) if bits > 64 else p, p & ((1 << (bits - 64)) - 1) if bits > 64 else 0) for p in wanted]
            signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
            inside = keyed.sparkSession.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "q1 long, q2 long")  # a row for each open splitter
            rows = rows.join(F.broadcast(inside), (q1 == F.col("q1")) & (q2 == F.col("q2")), "left_semi")
        counted = rows.groupBy(p1, p2).agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("_size").alias("most")).collect()
        extra = max(0, bits + more - 64)
        bins: dict[int, list[tuple[int, int, int]]] = {}
        for r in counted:
            prefix = (unsigned(r["p1"]) << extra) | unsigned(r["p2"])
            bins.setdefault(prefix >> more, []).append((prefix, r["bytes"], r["rows"]))
        if total is None:
            total = sum(b for _, b, _ in bins.get(0, []))
            largest = max((r["most"] for r in counted), default=0)
        next_wanted: dict[int, list[int]] = {}
        next_base: dict[int, tuple[int, int]] = {}
        # A bin of the first 64 bits is one text's.
        slack = max(GROUP_TOLERANCE * total / parts, largest) if bits + more == 64 else tolerance * total / parts
        for parent, targets in wanted.items():
            below, n = base[parent]
            todo = iter(targets)
            target = next(todo, None)
            last = bits + more == 128
            for prefix, size, count in sorted(bins.get(parent, [])):
                while target is not None and total * target / parts <= below + size:
                    aim = total * target / parts
                    lower, upper = aim - below, below + size - aim
                    if min(lower, upper) <= slack or last or count == 1:  # a single row is not parted
                        edge = prefix if lower <= upper else prefix + 1
                        found[target] = (edge << (128 - bits - more), n if lower <= upper else n + count)
                    else:
                        next_wanted.setdefault(prefix, []).append(target)
                        next_base[prefix] = (below, n)
                    target = next(todo, None)
                below, n = below + size, n + count
            while target is not None:  # only without rows
                found[target] = (1 << 128, n)
                target = next(todo, None)
        bits += more
        wanted, base = next_wanted, next_base
        step = max(1, (ROUND_BINS // max(1, len(wanted))).bit_length() - 1)
    return [found[k] for k in range(1, parts)]


def shard_by_bytes(keyed: DataFrame, thin: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``keyed`` (row, _k1, _k2) as ``row, shard, slot``; ``thin``: its _k1, _k2 and _size as a table.

    Shards' bytes are near equal; slots are gapless from 0, in order of the keys. Rows that are equal in id and text
    stay together (their slots among themselves are any). With fewer distinct rows than shards some shards stay
    empty; a table without rows gives none.
    """
    scratch = Scratch(keyed.sparkSession, "slots")
    sign = lambda v: v - (1 << 63)  # noqa: E731  the keys' order as signed numbers
    edges = [divmod(min(k, (1 << 128) - 1), 1 << 64) for k, _ in find_splitters(thin, shards, tolerance)]
    spots = F.array(*[F.struct(F.lit(sign(a)).cast("long").alias("_k1"), F.lit(sign(b)).cast("long").alias("_k2")) for a, b in edges]) if edges else None
    shard = F.size(F.filter(spots, lambda e: e <= F.struct("_k1", "_k2"))) if edges else F.lit(0)
    keys = ["shard", "_k1", "_k2"]
    ranged = keyed.withColumn("shard", shard).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = scratch.table(ranged.select("row", "shard", F.monotonically_increasing_id().alias("at")))
    pieces = ranged.groupBy("shard", F.shiftright("at", _PART_BITS).alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(F.col("shard").alias("s"), "part", (F.coalesce(first, F.lit(0)) - F.col("low")).alias("shift"))
    same = (F.col("shard") == F.col("s")) & (F.shiftright("at", _PART_BITS) == F.col("part"))
    return ranged.join(F.broadcast(pieces), same).select("row", "shard", (F.col("at") + F.col("shift")).alias("slot"))  # a row for each task and shard


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k1, k2 = sort_keys(F.col("doc_id"), F.col("text"))
    row = F.struct("doc_id", text_bytes(F.col("text")).alias("size"), text_crc(F.col("text")).alias("text_crc32"))
    thin = Scratch(spark, "shards").table(docs.select(row.alias("row"), k1.alias("_k1"), k2.alias("_k2")))
    out = shard_by_bytes(thin, thin.select("_k1", "_k2", F.col("row.size").alias("_size")))
    return out.select("row.*", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ``shard`` and ``slot`` (which replace columns of these names); null texts count as empty."""
    k1, k2 = sort_keys(F.col("doc_id"), F.col("text"))
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")])
    keyed = docs.select(row.alias("row"), text_bytes(F.col("text")).alias("_size"), k1.alias("_k1"), k2.alias("_k2"))
    thin = Scratch(spark, "shards").table(keyed.select("_k1", "_k2", "_size"))
    return shard_by_bytes(keyed.select("row", "_k1", "_k2"), thin).select("row.*", "shard", "slot").drop("_")
