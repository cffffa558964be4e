"""Token ids in Parquet files: list columns that can be read by document, by token span or without the tokens.

Texts are exchanged once, by ranges of their id, encoded in that order, and written by Spark's own Parquet writer
(a lost executor's files are never committed). A file holds ``doc_id``, ``part`` (the file's number), ``first`` (ids
of the part's documents before it), ``n_tokens``, ``meta`` (columns the caller keeps) and ``ids``. Ids are encoded by
dictionary or by deltas, ``first`` and integer keys by deltas; row groups and pages are small, and their indexes let a
filter on ``doc_id`` or ``first`` skip pages of ``ids``. A manifest has one row for each file, so that a document's
place among all tokens is its part's plus its own, and no task numbers the whole corpus.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, frugal

END = 1
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
#: Rows of a page at most, so that a page index can skip to a few documents.
PAGE_ROWS = 500
#: Ids that a task hands over at once (a longer document alone).
BATCH_IDS = 1 << 20
#: Words whose ids a worker remembers (about 200 bytes each); then it forgets all and starts anew.
MEMO_WORDS = 400_000
#: Files up to which the manifest (some 40 bytes a row) is broadcast when it is joined to the files' rows.
BROADCAST_FILES = 100_000
#: Latin letters, then ASCII punctuation without the apostrophe: what most words are.
_LETTERS = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_KEPT: dict = {}  # of a Python worker: its tokenizer


class WordMemo(dict):
    """From a word (bytes without white space) to its ids as little-endian bytes; unseen words go to the tokenizer."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        #: How the model sees Latin letters, if such a letter and a run of them are one piece each and points after them another.
        self.seen: dict[int, str] | None = None
        before, normal = tokenizer.pre_tokenizer, tokenizer.normalizer
        if before and normal:
            letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
            seen = {ord(c): before.pre_tokenize_str(c)[0][0] for c in letters}
            whole = "abc" + "".join(letters)
            pieces = [p for p, _ in before.pre_tokenize_str(whole + ".,;%&")]
            if pieces == [whole.translate(seen), ".,;%&"] and normal.normalize_str(whole) == whole and normal.normalize_str("AÉ") == "aé":
                self.seen = seen

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        found = _LETTERS.fullmatch(text) if self.seen else None
        if not found:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif found[2]:
            return self.setdefault(word, self[found[1].encode()] + self.points(found[2]))
        else:
            ids = [t.id for t in self.model.tokenize(text.lower().translate(self.seen) if not text.isascii() else text)]
        return self.setdefault(word, array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes())

    def points(self, text: str) -> bytes:
        word = text.encode()
        return self.get(word) or self.setdefault(word, np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())


class Encoder:
    """Ids of texts as little-endian bytes, the end id last.

    ``by_words``: for tokenizers that drop white space and fold ASCII letters' case, where a text's ids are those of its
    words one after the other; then each word is encoded once. Otherwise whole texts go to the tokenizer.
    """

    def __init__(self, tokenizer_json: str, by_words: bool, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.memo = WordMemo(self.tokenizer) if by_words else None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end], "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.memo is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        raw = text.encode()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        low = raw.lower()
        words = (raw if any(t.lower() in low for t in self.special) else low).split()  # an added token is told by its case
        return b"".join(map(self.memo.__getitem__, words)) + self.end


def _encoder(shared, by_words: bool, end: int) -> Encoder:
    """The worker's encoder; it keeps one."""
    key = (zlib.crc32(shared.value.encode()), len(shared.value), by_words, end)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(shared.value, by_words, end)
    return _KEPT[key]


def _chunks(batch: pa.RecordBatch, encode, known: dict):
    """The batch's rows with their ids, cut after about BATCH_IDS ids."""
    texts, begin, size, pieces = batch.column("text"), 0, 0, []
    for k in range(len(batch)):
        pieces.append(encode(texts[k].as_py() or ""))
        size += len(pieces[-1]) // 4
        if size >= BATCH_IDS or k == len(batch) - 1:
            lengths = np.fromiter((len(p) // 4 for p in pieces), np.int64)
            ends = np.cumsum(lengths)
            values = pa.array(np.frombuffer(b"".join(pieces), "<u4").astype(np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
            rows = batch.slice(begin, len(pieces))
            columns = [rows.column("doc_id"), pa.array(ends - lengths + known["first"], pa.int64()), pa.array(lengths, pa.int64()), rows.column("meta"), ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "first", "n_tokens", "meta", "ids"])
            known["first"] += int(ends[-1])
            begin, size, pieces = k + 1, 0, []


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, by_words: bool = False, encoding: str = "dictionary", end: int = END, doc_id: str = "doc_id",
                 text: str = "text", meta: Collection[str] = (), row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write every document's ids, the end id last, under ``path``, in ascending order of ``doc_id``.

    Null texts count as empty (the end id alone); texts of any length are encoded whole. Null ids come first; rows equal in
    id are ordered by a digest of their text, repeated rows keep a row each (so that one id may fill many
    files). A table without rows gives files without rows. ``encoding``: ``dictionary`` or ``delta`` for ``ids``.
    Other columns are left out, but for those in ``meta``, which go into a struct and so may have any name.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())  # a vocabulary: some MB at any number of documents
    kept = F.struct(F.lit(None).cast("boolean").alias("_"), *[F.col(f"`{c}`") for c in meta])
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), kept.alias("meta"))
    order = ["doc_id", "_hash", "_at"]
    rows = rows.withColumns({"_hash": F.xxhash64(F.coalesce("text", F.lit(""))), "_at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", "meta")

    def run(batches):
        encode, known = _encoder(shared, by_words, end), {"first": 0}
        for batch in batches:
            yield from _chunks(batch, encode, known)

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(frugal(run), f"doc_id {kinds['doc_id']}, first long, n_tokens long, meta {kinds['meta']}, ids array<int>").withColumn("part", F.spark_partition_id())
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#first": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    with arrow_rows(spark, 1000):
        found.write.options(**options).parquet(f"{path}/tokens")
    shared.destroy()
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    parts.withColumn("first_token", F.coalesce(before, F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, n_docs, n_tokens, first_token``: a row for each file that holds documents."""
    return spark.read.parquet(f"{path}/manifest")


def read_documents(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """``doc_id, part, start, n_tokens, meta`` and, with ``tokens``, ``ids``: without them no page of ids is read.

    ``start`` counts the ids of all documents before it. A filter on ``doc_id`` reaches the files' page indexes.
    """
    parts = read_manifest(spark, path).select(F.col("part").alias("_part"), "first_token")
    if parts.count() <= BROADCAST_FILES:
        parts = F.broadcast(parts)
    rows = spark.read.parquet(f"{path}/tokens").join(parts, F.col("part") == F.col("_part"))
    return rows.select("doc_id", "part", (F.col("first") + F.col("first_token")).alias("start"), "n_tokens", "meta", *(["ids"] if tokens else []))


def read_span(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """``start`` and ``ids`` of the tokens from place ``begin`` to before ``end``, cut out of the documents that hold them.

    The manifest tells the parts; their bounds, and within one part the documents', are filters of the scan.
    """
    last = F.col("first_token") + F.col("n_tokens")
    held = read_manifest(spark, path).where((F.col("first_token") < end) & (last > begin))
    low, high, first = held.agg(F.min("part"), F.max("part"), F.min("first_token")).first()
    rows = read_documents(spark, path).where(F.col("part").between(low, high) if low is not None else F.lit(False))
    if low is not None and low == high:  # in one part, what a document has in front of it is known
        rows = rows.where(F.col("start") - first < end - first)
    rows = rows.where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))
    skip = F.greatest(F.lit(begin) - F.col("start"), F.lit(0)).cast("int")
    size = F.least(F.lit(end) - F.col("start"), F.col("n_tokens")).cast("int") - skip
    return rows.select((F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, size).alias("ids"))


def ids_crc32(ids: Column) -> Column:
    """The CRC-32 of ids as little-endian unsigned 32-bit integers (null: null)."""

    def run(lists: pa.Array) -> pa.Array:
        raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes())
        ends = lists.offsets.to_numpy() * 4
        return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.int64(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "long")(ids)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark, 'token-files').root}/tokens-1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), by_words=True, meta=("lang", "source"))
    return read_documents(spark, path).select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), ids_crc32(F.col("ids")).alias("ids_crc32"))
