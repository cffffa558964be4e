"""Helpers the training-data operators share: tables in the shared folder, words, hashes."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the operators' contracts: blank and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
_MASK = (1 << 64) - 1
_PART_BITS = 33  # of monotonically_increasing_id, for a row's number in its partition
#: Groups from this size on are worth the milliseconds that :func:`give_back` takes.
LARGE_GROUP_BYTES = 1 << 20
_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a local session gets a temporary folder; a cluster is refused, since its
    machines would not see each other's files.
    """
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="quillmark-"))
    return _LOCAL_DIR[0]


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back with the same schema."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ranked(rows: DataFrame, tree: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` as a table with ``rank`` and ``n``: the row's number in its tree by ``order``, and the tree's rows.

    Rows are sorted in ranges; each range's rows of a tree are numbered from what the ranges before it hold.
    """
    by = [F.col(c).asc_nulls_first() for c in [*tree, *order]]
    laid = scratch.table(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PART_BITS)
    pieces = laid.groupBy(*tree, part.alias("_part")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*tree)  # a row for each tree and task that has some of it
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*[F.col(c).alias(f"_{c}") for c in tree], F.col("_part"), (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    same = part == F.col("_part")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return laid.join(pieces, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "n")


def words_column(text: Column) -> Column:
    """Native array of the words of a text (null: none)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Native number of words, without building strings for them (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def new_vocab() -> defaultdict:
    """A dict that numbers unseen words in order of arrival."""
    vocab: defaultdict = defaultdict()
    vocab.default_factory = vocab.__len__
    return vocab


def word_hashes(words) -> np.ndarray:
    """64-bit digests of words (bytes), in their order."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values: spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, so that high zero bytes cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.compress(planes[:used].tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    """The inverse of :func:`pack`."""
    used = blob[0]
    raw = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8)
    planes = raw.reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pow2_at_least(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))


class Bitmap:
    """A Bloom filter of fixed size over 64-bit keys: the broadcast part of a semi-join.

    It lets a join ship only rows that may have a partner. It is 8 MB at any number of keys; with
    more keys it passes more rows that have none, which the exact join after it removes.
    """

    BITS = 26
    _BLOCK = 13

    def __init__(self, keys: DataFrame, column: str):
        bit = F.shiftrightunsigned(F.col(column), 64 - self.BITS)
        bits = keys.select(bit.alias("bit")).distinct()
        blocks = bits.groupBy(F.shiftright("bit", self._BLOCK).alias("block")).agg(
            F.collect_list(F.col("bit").bitwiseAND((1 << self._BLOCK) - 1).cast("short")).alias("bits")
        )
        # At most 2^13 blocks come back; as each is packed on the executors, 1 KB from each.
        packed = blocks.mapInArrow(self._pack, "block long, bytes binary").collect()
        table = np.zeros(1 << (self.BITS - 3), np.uint8)
        size = 1 << (self._BLOCK - 3)
        for row in packed:
            table[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bytes"], np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def _pack(batches):
        for batch in batches:
            out = []
            for bits in batch.column("bits"):
                flags = np.zeros(1 << Bitmap._BLOCK, np.uint8)
                flags[np.array(bits.as_py(), np.int64)] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "bytes"])

    def test(self):
        """A function of int64 keys, for use inside tasks: False where a key is surely not among the keys."""
        shared, bits = self.shared, self.BITS

        def probe(keys: np.ndarray) -> np.ndarray:
            at = keys.view(np.uint64) >> np.uint64(64 - bits)
            return (shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

        return probe

    def may_hold(self, key: Column) -> Column:
        """False where the key is surely not among the keys."""
        probe = self.test()

        def run(keys: pa.Array) -> pa.Array:
            return pa.array(probe(keys.to_numpy(zero_copy_only=False)), pa.bool_())

        return F.arrow_udf(run, "boolean")(key)

    def drop(self) -> None:
        """Give the broadcast's memory back; no later step may use this."""
        self.shared.destroy()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, label), label the least node of its component.

    Every round takes the least label among neighbours and then the label's own label, each round
    written to the shared folder; no component ever comes together in one task.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = scratch.table(step)
        heads = step.select(F.col("node").alias("head"), F.col("label").alias("of_head"))
        jumped = step.join(heads, F.col("label") == F.col("head")).select("node", "old", F.least("label", "of_head").alias("label"))
        jumped = scratch.table(jumped)
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def give_back() -> None:
    """Return memory that this worker's allocators hold but no longer use; without it idle workers keep their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library has it
    if trim:
        trim(0)


def frugal(run):
    """``run`` (batches to batches) in a worker that gives its memory back when a task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def frugal_group(run):
    """``run`` (a group's table to a table), likewise, after each group of some MB."""

    def task(rows: pa.Table) -> pa.Table:
        out = run(rows)
        if rows.nbytes >= LARGE_GROUP_BYTES:
            give_back()
        return out

    return task


def frugal_cogroup(run):
    """The same for a pair of groups."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        if left.nbytes + right.nbytes >= LARGE_GROUP_BYTES:
            give_back()
        return out

    return task


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 2000):
    """Let Arrow batches have ``rows`` rows at most in what runs inside; the session's setting comes back after.

    Ten thousand texts of some KB (Spark's default), at once in the JVM, on the way and in Python, are
    most of an executor's memory. Results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
