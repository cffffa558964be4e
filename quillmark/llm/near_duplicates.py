"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Distinct texts get a MinHash signature, which gives each tree of the forest a label of DEPTH values. A tree is a
prefix trie, held as its sorted labels: all trees are sorted at once by range, and each label's longest prefix in
common with its neighbours tells how deep it has company; labels without company at MIN_DEPTH go no further. The
matched prefix starts at the full depth and is shortened, a level at a time, until the recall that the pairs found
let expect reaches the target (:func:`expected_recall`).

Texts with a prefix in common are candidates. The pairs of small prefix groups are compared by whole signatures
first, five standard deviations wide; a large group is tied to its first member instead of writing out its pairs
(all of it is compared exactly below, so the two differ in work only, but for pairs five deviations off). What
hangs together after that is compared exactly, each text with each other of its cluster, by multiplying the
cluster's text by shingle matrix with its transpose, in blocks of texts. So a group of any size gives one row per
text, all links between different texts of a cluster are counted, and no row is ever made for a pair of a large group.

Copies are set aside first: one text stands for all its copies. Only texts that may belong to a cluster send their
shingles, which a Bloom filter of fixed size picks out during the second reading.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, arrow_rows, components, frugal, frugal_group, mix64, new_vocab, odd_multipliers, word_hashes

NGRAM = 5
#: The threshold as a fraction, so that the exact test needs no rounding.
SIMILARITY = (4, 5)
TREES, DEPTH, MIN_DEPTH, TARGET_RECALL = 32, 10, 6, 0.998
#: Members up to which a prefix group's pairs are written out (more: the group is compared as a cluster).
SMALL_GROUP = 24
#: Texts, and shingles, that a block of a large cluster has about.
BLOCK, BLOCK_SHINGLES = 512, 500_000
_COLUMNS = 4096
_CHUNK_WORDS = 400_000
_SKETCH = "uid long, doc_id long, f1 long, f2 long, shingles long, sig binary"


def found_at(depth: int, similarity):
    """The probability that some tree finds a pair of this similarity at a prefix length."""
    return 1 - (1 - similarity**depth) ** TREES


def expected_recall(depth: int, threshold: float, agreed: dict[int, int]) -> float:
    """The share of pairs just above the threshold that a prefix length finds, by the pairs that it did find.

    ``agreed``: number of pairs by how many of their values agree. A pair found at similarity s stands for
    1 / found_at(depth, s) pairs there are. Only the lowest quarter above the threshold counts, where prefixes
    miss most, and one pair at the threshold itself is added, so that no pairs are no evidence of recall.
    """
    found, there = 1.0, 1.0 / found_at(depth, threshold)
    for n, pairs in agreed.items():
        similarity = n / (TREES * DEPTH)
        if threshold <= similarity <= threshold + (1 - threshold) / 4:
            found += pairs
            there += pairs / found_at(depth, similarity)
    return found / there


def fingerprint() -> tuple:
    """Two native 64-bit digests of a text, which stand for it (without a word: those of the empty text)."""
    blank = F.coalesce(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")), F.lit("")) == ""
    text = F.when(blank, F.lit("")).otherwise(F.col("text"))
    return F.xxhash64(F.lit("1"), text).alias("f1"), F.xxhash64(F.lit("2"), text).alias("f2")


def shingles_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit digests; a shorter text is one shingle, an empty one none."""
    vocab = new_vocab()
    parts = []
    for text in texts:
        words = (text or b"").split()
        parts.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
    hashes = word_hashes(vocab)
    mult = odd_multipliers(NGRAM, 5)
    out = []
    for ids in parts:
        if not len(ids):
            out.append(np.zeros(0, np.uint64))
            continue
        h = hashes[ids]
        n = min(NGRAM, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total = total + mix64(h[i : len(h) - n + 1 + i] * mult[i])
        out.append(np.unique(mix64(total)))
    return out


def _chunks(texts: list[bytes | None]):
    """Runs of texts of bounded size (a longer text alone)."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or b"") // 6
        if size >= _CHUNK_WORDS:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _sketch(batches):
    """Signatures: TREES labels of DEPTH bytes each (none for a text without words). Copies in a batch share one."""
    mult = odd_multipliers(TREES * DEPTH, 17)
    task = TaskContext.get()
    uid = (task.partitionId() if task else 0) << 36
    for batch in batches:
        f1, f2 = batch.column("f1").to_pylist(), batch.column("f2").to_pylist()
        first: dict[tuple, int] = {}
        for k, key in enumerate(zip(f1, f2)):
            first.setdefault(key, k)
        order = sorted(first.values())
        texts = batch.column("text").cast(pa.binary())
        texts = [texts[k].as_py() for k in order]
        sizes, sigs = [], []
        for lo, hi in _chunks(texts):
            sets = shingles_of(texts[lo:hi])
            full = [s for s in sets if len(s)]
            if full:
                starts = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
                joined = np.concatenate(full)
                sig = np.stack([(mix64(np.minimum.reduceat(joined * m, starts)) & np.uint64(255)).astype(np.uint8) for m in mult], axis=1)
            rows = iter(range(len(full)))
            sizes += [len(s) for s in sets]
            sigs += [sig[next(rows)].tobytes() if len(s) else None for s in sets]
        at = {f: i for i, f in enumerate(order)}
        of = [at[first[key]] for key in zip(f1, f2)]
        n = len(of)
        columns = [pa.array(np.arange(uid, uid + n)), batch.column("doc_id"), batch.column("f1"), batch.column("f2"),
                   pa.array([sizes[k] for k in of], pa.int64()), pa.array([sigs[k] for k in of], pa.binary())]
        uid += n
        yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "f1", "f2", "shingles", "sig"])


def _labels(rows: pa.Array) -> np.ndarray:
    """Binary values of one length as the rows of an array."""
    return np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(len(rows), -1)


def _company(batches):
    """Sorted labels to those with company: ``shared`` is the longest prefix in common with a neighbour.

    The first and last row of a batch may have their company in another one, so they count as having it; the
    sizes of groups, which are counted afterwards, leave out those that haven't.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, label = batch.column("tree").to_numpy(), _labels(batch.column("label"))
        same = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
        common = np.cumprod(same, axis=1).sum(axis=1)
        shared = np.maximum(np.append(DEPTH, common), np.append(common, DEPTH)).astype(np.int32)
        kept = batch.append_column("shared", pa.array(shared)).filter(pa.array(shared >= MIN_DEPTH))
        yield kept


def _agreement(batches):
    """How many values of two signatures agree."""
    for batch in batches:
        agree = (_labels(batch.column("sa")) == _labels(batch.column("sb"))).sum(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree.astype(np.int32))], ["a", "b", "agree"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every two of the sets, by blocks of shingles that two or more have."""
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, count = np.unique(joined, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[which][shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _COLUMNS])
        x = np.zeros((len(sets), min(_COLUMNS, int(number[-1]) + 1 - first)), np.float32)
        x[row[lo:hi], column[lo:hi] - first] = 1
        out += x @ x.T
    return out


def _verify(threshold):
    """One group of texts (or two blocks of a large cluster): links of each, and what they hang together with."""
    top, bottom = threshold

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        uid, copies, block = (table.column(c).to_numpy() for c in ("uid", "copies", "block"))
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("sent")]
        size = np.array([len(s) for s in sets], np.float64)
        common = overlaps(sets).astype(np.float64)
        linked = bottom * common >= top * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        linked &= (common > 0) | ((size == 0)[:, None] & (size == 0)[None, :])
        if block.min() != block.max():  # pairs within a block are counted by the block's own group
            linked &= block[:, None] != block[None, :]
        links = linked @ copies
        head = np.arange(len(uid))
        while True:  # least number among the linked, until nothing changes
            least = np.where(linked, head[None, :], len(uid)).min(axis=1) if len(uid) else head
            new = np.minimum(head, least)
            new = new[new]
            if (new == head).all():
                break
            head = new
        return pa.Table.from_pydict({"uid": uid, "links": links.astype(np.int64), "head": uid[head]})

    return run


def forest(reps: DataFrame) -> DataFrame:
    """``tree, label, uid, shared`` of the labels that have company at MIN_DEPTH or deeper.

    Equal labels may be many (a large group of near copies), so ranges are also cut by ``uid``.
    """
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    labels = reps.where("sig is not null").select("uid", "sig", F.explode(trees).alias("tree"))
    labels = labels.select("tree", F.substring("sig", F.col("tree") * DEPTH + 1, F.lit(DEPTH)).alias("label"), "uid")
    ordered = labels.repartitionByRange("tree", "label", "uid").sortWithinPartitions("tree", "label", "uid")
    return ordered.mapInArrow(frugal(_company), "tree int, label binary, uid long, shared int")


def candidates(trie: DataFrame, reps: DataFrame, depth: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Candidates at a prefix length: pairs ``a, b, agree`` of small groups, and ties ``a, b`` of large ones."""
    at = trie.where(F.col("shared") >= depth).select(F.xxhash64("tree", F.substring("label", 1, depth)).alias("key"), "uid")
    sizes = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("hub")).where("n > 1")
    grouped = at.join(sizes, "key")
    # A group found by several trees is one list; lists of one length, not pairs, are told apart.
    lists = grouped.where(F.col("n") <= SMALL_GROUP).groupBy("key").agg(F.sort_array(F.collect_list("uid")).alias("m")).select("m").distinct()
    pairs = lists.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, F.lit(SMALL_GROUP))).alias("b")).distinct()
    left, right = reps.select(F.col("uid").alias("a"), F.col("sig").alias("sa")), reps.select(F.col("uid").alias("b"), F.col("sig").alias("sb"))
    floor = (threshold - 5 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5) * TREES * DEPTH
    alike = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(frugal(_agreement), "a long, b long, agree int").where(F.col("agree") >= floor)
    ties = grouped.where((F.col("n") > SMALL_GROUP) & (F.col("uid") != F.col("hub"))).select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct()
    return alike, ties


def near_duplicates(docs: DataFrame, threshold=SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, f1, f2, class_id, n_links, stays``.

    ``class_id`` is the least id of all rows that hang together by links (null if they all have null),
    ``n_links`` the number of other rows with a similarity of at least the threshold, copies included.
    Equal texts are copies, at any length; texts without a word (null, empty, blank) have no shingles and are
    copies of each other. Repeated rows are copies. ``stays`` marks the rows with the id and the text
    that stand for a class: the least id (null last), of its texts the one with the least digests; so it
    doesn't depend on how rows lie in files. ``f1, f2`` stand for the text. A table without rows gives
    none. Other columns of ``docs``, of any name, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    t = threshold[0] / threshold[1]
    with arrow_rows(spark):
        sketched = scratch.table(source.select("doc_id", "text", *fingerprint()).mapInArrow(frugal(_sketch), _SKETCH))
        texts = scratch.table(sketched.groupBy("f1", "f2").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id")))
        reps = scratch.table(sketched.join(texts.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "doc_id", "f1", "f2", "shingles", "sig"))
        trie = scratch.table(forest(reps))
        for depth in range(DEPTH, MIN_DEPTH - 1, -1):
            alike, ties = candidates(trie, reps, depth, t)
            alike = scratch.table(alike)
            agreed = {r["agree"]: r["n"] for r in alike.groupBy("agree").agg(F.count(F.lit(1)).alias("n")).collect()}  # TREES * DEPTH rows at most
            if depth == MIN_DEPTH or expected_recall(depth, t, agreed) >= TARGET_RECALL:
                break
            scratch.drop(alike)
        clusters = components(alike.select("a", "b").union(ties), scratch)
        scratch.drop(trie)

        # Every cluster's texts, with their shingles, read again by those that may belong to one.
        wanted = reps.join(clusters.withColumnRenamed("node", "uid"), "uid").join(texts.select(F.col("rep").alias("uid"), "copies"), "uid")
        wanted = scratch.table(wanted.select("uid", "f1", "f2", F.col("label").alias("cluster"), "copies", "shingles", F.xxhash64("f1", "f2", "doc_id").alias("own")))
        bitmap = Bitmap(wanted, "own")
        columns = source.select("text", *fingerprint(), "doc_id").select("text", "f1", "f2", F.xxhash64("f1", "f2", "doc_id").alias("own"))
        sent = columns.mapInArrow(frugal(_shingled(bitmap.test())), "f1 long, f2 long, sent binary").dropDuplicates(["f1", "f2"])
        sizes = wanted.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        ready = scratch.table(wanted.join(sizes, "cluster").join(sent, ["f1", "f2"]).select("cluster", "blocks", "uid", "copies", "sent"))
        bitmap.drop()
        ready = ready.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
        ready = ready.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        ready = ready.withColumn("one", F.least("block", "with")).withColumn("two", F.greatest("block", "with"))
        fields = ["uid", "copies", "block", "sent"]
        checked = ready.groupBy("cluster", "one", "two").applyInArrow(frugal_group(lambda g: _verify(threshold)(g.select(fields))), "uid long, links long, head long")
        checked = scratch.table(checked)
        linked = components(checked.where("uid <> head").select(F.col("uid").alias("a"), F.col("head").alias("b")), scratch)
        counts = checked.groupBy("uid").agg(F.sum("links").alias("links"))

        by_text = texts.join(counts.withColumnRenamed("uid", "rep"), "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        by_text = by_text.select("f1", "f2", "least_id", "copies", F.coalesce("label", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
        by_text = scratch.table(by_text)
        first = F.min(F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), "f1", "f2")).alias("first")
        classes = by_text.groupBy("class").agg(first)
        chosen = (F.col("f1") == F.col("first.f1")) & (F.col("f2") == F.col("first.f2"))
        by_text = by_text.join(classes, "class").select("f1", "f2", "least_id", F.col("first.id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), chosen.alias("chosen"))
        by_text = scratch.table(by_text)
    stays = F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("least_id"))
    return sketched.select("doc_id", "f1", "f2").join(by_text, ["f1", "f2"]).select("doc_id", "f1", "f2", "class_id", "n_links", stays.alias("stays"))


def _shingled(may_hold):
    """The shingles of the texts whose key may be wanted."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(batch.column("own").to_numpy()), pa.bool_()))
            first = {}
            f1, f2 = batch.column("f1").to_pylist(), batch.column("f2").to_pylist()
            for k, key in enumerate(zip(f1, f2)):
                first.setdefault(key, k)
            keep = sorted(first.values())
            column = batch.column("text").cast(pa.binary())
            texts = [column[k].as_py() for k in keep]
            for lo, hi in _chunks(texts):
                sets = [s.tobytes() for s in shingles_of(texts[lo:hi])]
                rows = keep[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array([f1[k] for k in rows], pa.int64()), pa.array([f2[k] for k in rows], pa.int64()), pa.array(sets, pa.binary())], ["f1", "f2", "sent"])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each class.

    A class keeps one of the rows with the id and text that stand for it; of several the one whose columns
    have the least digest, so reruns agree. Rows whose key isn't in the Bloom filter of the rows in question
    go through at once; the others meet their list. Columns of any name pass through untouched. Null and empty
    texts are one class. A table without rows gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "keep")
    ids = scratch.table(near_duplicates(docs).groupBy("f1", "f2", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("stays").alias("stays")))
    asked = scratch.table(ids.where("n > 1 or not stays").select(F.col("f1").alias("_1"), F.col("f2").alias("_2"), F.col("doc_id").alias("_3"), "stays", F.xxhash64("f1", "f2", "doc_id").alias("own")))
    bitmap = Bitmap(asked, "own")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(whole.alias("row"), *fingerprint(), F.col("doc_id").cast("long").alias("id")).withColumn("maybe", bitmap.may_hold(F.xxhash64("f1", "f2", "id")))
    through = marked.where("not maybe").select("row")
    same = (F.col("f1") == F.col("_1")) & (F.col("f2") == F.col("_2")) & F.col("id").eqNullSafe(F.col("_3"))
    held = marked.where("maybe").join(asked.select("_1", "_2", "_3", "stays"), same, "left").where("stays is null or stays")
    single = held.where("stays is null").select("row")
    several = held.where("stays").groupBy("f1", "f2", "id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return through.union(single).union(several).select("row.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
