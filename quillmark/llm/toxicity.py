"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one or two words between them of a
whole text (lower case), hashed to 2^20 coordinates. Training is one pass per epoch over a bounded
sample of labelled rows, which come to it as coordinates, not as texts; each coordinate has its own learning rate, and L1 leaves few weights, which
are broadcast (2^20 pairs at most, some MB) and looked up for every text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, frugal, frugal_group, mix64, new_vocab, word_hashes

#: The bound of the training sample: labelled rows with the smallest hash of their id.
TRAIN_ROWS = 12_288
#: And of its size: coordinates of all its rows together (rows beyond it, in the order of their hashes, are left out).
TRAIN_COORDINATES = 30_000_000
EPOCHS = 5
BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
THRESHOLD = 0.3
#: Words a pass over a batch holds at most (a longer text is a pass of its own).
_CHUNK = 1_000_000
_WORD = re.compile(r"\w+")
_BIAS = 0
_WEIGHTS = "coordinates array<int>, weights array<double>"


def _coordinates(texts) -> tuple[list[np.ndarray], np.ndarray, int]:
    """All texts' features: for each kind an array of coordinates, with the feature's text number."""
    vocab = new_vocab()
    parts, lens = [], []
    for text in texts:
        words = _WORD.findall((text or "").lower())
        parts.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
        lens.append(len(words))
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lens)), lens)
    hashes = word_hashes(w.encode() for w in vocab)
    mask = np.uint64((1 << BITS) - 1)
    at = hashes[tokens] if len(tokens) else np.zeros(0, np.uint64)
    coords, owners = [(mix64(hashes) & mask).astype(np.int64)[tokens] if len(tokens) else tokens], [owner]
    for gap in (1, 2, 3):
        if len(at) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = mix64(at[:-gap] * np.uint64(2 * gap + 1) + at[gap:])
            coords.append((pair & mask).astype(np.int64)[same])
            owners.append(owner[gap:][same])
    return np.concatenate(coords), np.concatenate(owners), len(lens)


def _ftrl(examples: list[np.ndarray], labels: list[int], epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the examples in order; the non-zero coordinates and their weights."""
    z, n = np.zeros((1 << BITS)), np.zeros((1 << BITS))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(examples, labels):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept]


def _featured(batches):
    """The distinct coordinates of each text, the bias among them."""
    for batch in batches:
        found = [np.union1d(_coordinates([t.as_py()])[0], [_BIAS]).astype(np.int32) for t in batch.column("text")]
        arrays = [batch.column(c) for c in ("doc_id", "toxic", "rank")]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "rank", "size", "at"])


def _train(epochs: int):
    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rank", "ascending"), ("doc_id", "ascending")])
        examples = [at.values.to_numpy() for at in rows.column("at")]
        kept, w = _ftrl(examples, rows.column("toxic").to_pylist(), epochs)
        schema = pa.schema([("coordinates", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))])
        return pa.Table.from_pydict({"coordinates": [kept.astype(np.int32)], "weights": [w]}, schema=schema)

    return fit


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[list[int], list[float]]:
    """Weights from at most ``train_rows`` of ``labels`` (doc_id, toxic); empty without any.

    Rows with a null id or label are no examples; of several labels of an id the largest holds, of several texts
    the least (a null text is empty). Other columns of either table, of any name, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    chosen = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(train_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # train_rows short rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("rank").alias("rank"))
    with arrow_rows(spark):
        rows = scratch.table(rows.select(F.col("doc_id").cast("long"), "toxic", "rank", "text").mapInArrow(frugal(_featured), "doc_id long, toxic int, rank long, size long, at array<int>"))
    before = F.sum("size").over(Window.orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over train_rows sizes
    fitting = rows.select("doc_id", "rank", "size").withColumn("sum", before).where(F.col("sum") <= TRAIN_COORDINATES).select("doc_id")
    fitted = rows.join(fitting, "doc_id", "left_semi").withColumn("part", F.lit(1)).groupBy("part").applyInArrow(frugal_group(_train(epochs)), _WEIGHTS).collect()
    return (fitted[0]["coordinates"], fitted[0]["weights"]) if fitted else ([], [])


def score(docs: DataFrame, coordinates: list[int], weights: list[float], extra: list[str] = ()) -> DataFrame:
    """``doc_id``, the ``extra`` columns and ``score`` of every row; 0 throughout without weights.

    Null and empty texts have the bias alone; texts of any length are scored whole. Repeated rows get the same
    score; a table without rows gives none. Columns that aren't named in ``extra`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.array(coordinates, np.int64), np.array(weights, np.float32)))
    kept = docs.select("doc_id", *extra, "text")
    fields = [f for f in kept.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def run(batches):
        at, w = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[at] = w
        bias = float(table[_BIAS])

        def scores(texts):
            coords, owner, n = _coordinates(texts)
            weighty = np.flatnonzero((table[coords] != 0) & (coords != _BIAS))
            once = np.unique(owner[weighty] * (1 << BITS) + coords[weighty])  # a feature counts once in a text
            total = np.bincount(once >> BITS, weights=table[once & ((1 << BITS) - 1)], minlength=n) + bias
            return 1 / (1 + np.exp(-np.clip(total, -30, 30))) if len(at) else np.zeros(n)

        for batch in batches:
            out, waiting, size = [], [], 0
            for text in batch.column("text"):
                text = text.as_py()
                waiting.append(text)
                size += len(text or "") // 4
                if size >= _CHUNK:
                    out.append(scores(waiting))
                    waiting, size = [], 0
            if waiting:
                out.append(scores(waiting))
            values = np.concatenate(out) if out else np.zeros(0)
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [pa.array(values, pa.float64())], [*names, "score"])

    return kept.mapInArrow(frugal(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = train(docs, labels.where(~held))
    scored = score(docs.withColumn("held_out", held), *found, extra=["held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
