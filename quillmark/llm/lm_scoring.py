"""LM scoring with a weighted backoff automaton.

The model is a trigram model written as an automaton. The root state has an arc for every word; every training
word is a state, with an arc for each word seen after it; every training word pair is a state too. Each state but
the root has a failure arc to its next shorter suffix (pair to word, word to root). A word without an arc takes
the failure arc (its weight is added) and is looked for there. One left-to-right traversal carries the state
through each text and adds up log10 weights; an arc leads to the longest suffix of what was read that is a state.

Weights are interpolated, each level in Jelinek-Mercer form with absolute discounts:
    p(w | h) = (1 - l(h)) c(h w) / c(h) + l(h) p(w | h'),    l(h) = D c(h)^(a - 1),    h' the shorter suffix
    p(w)     = (c(w) + 1) / (N + V + 1)
The weights left for one context sum to 1. ``D`` comes from the counts of counts of a level's n-grams,
and ``a`` is the exponent of the vocabulary law that gives the number of the level's distinct n-grams when it
is summed over all its contexts; both use all training documents.

The counts never sit in one place. Documents are read in batches; a batch sends the digests of its
n-grams, with its training counts, to the count table's buckets (by digest, so no word is hot),
each bucket adds up what all batches sent, and answers each batch with the totals of the n-grams
that the batch asked for. The batch then has the part of the automaton that its texts can reach. A batch sends
each bucket one frame, so there are batches times buckets of them, but never more than n-grams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, frugal_cogroup, frugal_group, mix64, new_vocab, pack, pow2_at_least, unpack, word_hashes

#: Tokens a batch holds at least before it is written out (a longer text is a batch of its own).
BATCH_TOKENS = 1_000_000
#: Tokens for each bucket of the count table; a token has three n-grams, of which most batches send two or more.
BUCKET_TOKENS = 500_000
#: Bits of a digest that are sent beyond those that number all n-grams: one shares its digest with odds of 2^-22.
SPARE_BITS = 22
ORDER = 3
END_WORD = b" end of text"  # holds a blank, so no word equals it

_LAYOUT = "batch long, ids array<long>, held array<boolean>, lens binary, words binary, tokens binary, n_tokens long"
_MESSAGE = "bucket long, gram int, batch long, keys binary, counts binary"
_REPLY = "batch long, gram int, bucket long, counts binary, bins binary, stats array<double>"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _layouts(batches):
    """Documents to batches: the digests of a batch's words and its texts as word numbers."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    state = {"ids": [], "held": [], "lens": [], "parts": [], "n": 0, "vocab": new_vocab()}
    state["vocab"][END_WORD]

    def flush():
        nonlocal number
        words = word_hashes(state["vocab"])
        row = {
            "batch": [number], "ids": [state["ids"]], "held": [state["held"]],
            "lens": [pack(np.array(state["lens"], np.uint64))], "words": [words.tobytes()],
            "tokens": [pack(np.concatenate(state["parts"]))], "n_tokens": [state["n"]],
        }
        number += 1
        state.update(ids=[], held=[], lens=[], parts=[], n=0, vocab=new_vocab())
        state["vocab"][END_WORD]
        return pa.RecordBatch.from_pydict(row, schema=_arrow(_LAYOUT))

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), texts):
            words = (text.as_py() or b"").lower().split()
            tokens = np.zeros(len(words) + 1, np.uint32)  # the last is the end token, word 0
            tokens[:-1] = np.fromiter(map(state["vocab"].__getitem__, words), np.uint32, len(words))
            state["ids"].append(doc_id)
            state["held"].append(bool(held))
            state["lens"].append(len(tokens))
            state["parts"].append(tokens)
            state["n"] += len(tokens)
            if state["n"] >= BATCH_TOKENS:
                yield flush()
    if state["ids"]:
        yield flush()


class _Batch:
    """A layout row, opened: its tokens, its distinct n-grams and their digests in order.

    ``of[n]`` has each token's n-gram that ends there (-1: a text's first token has no trigram).
    """

    def __init__(self, lens, words, tokens, key_bits: int):
        self.lens = unpack(lens).astype(np.int64)
        words = np.frombuffer(words, np.uint64)
        self.tokens = unpack(tokens).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 0  # the end of the text before stands for the start of this one
        self.pairs, pair_of = np.unique(before * len(words) + self.tokens, return_inverse=True)
        self.left, self.right = np.divmod(self.pairs, len(words))
        later = np.ones(len(self.tokens), bool)
        later[self.starts] = False
        later = np.flatnonzero(later)
        triples, triple_of = np.unique(pair_of[later - 1] * len(words) + self.tokens[later], return_inverse=True)
        self.head, last = np.divmod(triples, len(words))  # a trigram's context, and (below) the bigram that it ends with
        self.tail = np.searchsorted(self.pairs, self.right[self.head] * len(words) + last)
        self.of = {1: self.tokens, 2: pair_of, 3: np.full(len(self.tokens), -1)}
        self.of[3][later] = triple_of
        pair = mix64(mix64(words[self.left]) * np.uint64(3) + words[self.right])
        triple = mix64(mix64(pair[self.head]) * np.uint64(5) + words[last])
        shift = np.uint64(64 - key_bits)
        self.keys = {1: mix64(words) >> shift, 2: pair >> shift, 3: triple >> shift}
        self.order = {g: np.argsort(k, kind="stable") for g, k in self.keys.items()}

    def train_counts(self, held: np.ndarray) -> dict[int, np.ndarray]:
        train = np.repeat(~held, self.lens)
        return {g: np.bincount(self.of[g][train & (self.of[g] >= 0)], minlength=len(k)) for g, k in self.keys.items()}


def _messages(bucket_bits: int, key_bits: int):
    def send(batches):
        for record in batches:
            for row in record.to_pylist():
                batch = _Batch(row["lens"], row["words"], row["tokens"], key_bits)
                counts = batch.train_counts(np.array(row["held"], bool))
                for gram, keys in batch.keys.items():
                    out = {k: [] for k in ("bucket", "gram", "batch", "keys", "counts")}
                    order = batch.order[gram]
                    keys, n = keys[order], counts[gram][order]
                    bucket = (keys >> np.uint64(key_bits - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
                    cuts = np.flatnonzero(np.diff(bucket)) + 1
                    for lo, hi in zip([0, *cuts], [*cuts, len(keys)]) if len(keys) else ():
                        out["bucket"].append(int(bucket[lo]))
                        out["gram"].append(gram)
                        out["batch"].append(row["batch"])
                        steps = keys[lo:hi].copy()
                        steps[1:] -= keys[lo : hi - 1]
                        out["keys"].append(pack(steps))
                        out["counts"].append(pack(n[lo:hi]))
                    yield pa.RecordBatch.from_pydict(out, schema=_arrow(_MESSAGE))

    return send


def _bucket_totals(table: pa.Table) -> pa.Table:
    """One bucket of the count table: adds up all batches' counts and answers each batch.

    Digests that two batches both send are the same n-gram. Besides the answers it gives one row of
    statistics for each n-gram length, in bins by power of two: types, tokens; and types of count 1, 2.
    """
    out = {k: [] for k in ("batch", "gram", "bucket", "counts", "bins", "stats")}
    grams = table.column("gram").to_numpy()
    for gram in np.unique(grams):
        rows = table.filter(pa.array(grams == gram))
        keys = [np.cumsum(unpack(k.as_py()), dtype=np.uint64) for k in rows.column("keys")]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([unpack(c.as_py()) for c in rows.column("counts")]).astype(np.int64)
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        answers = np.split(total[which], np.cumsum(sizes)[:-1])
        for batch, answer in zip(rows.column("batch").to_pylist(), answers):
            out["batch"].append(batch)
            out["counts"].append(pack(answer))
            out["bins"].append(None)
            out["stats"].append(None)
        seen = total[total > 0]
        bins = np.floor(np.log2(seen)).astype(np.int64) if len(seen) else np.zeros(0, np.int64)
        types, tokens = np.bincount(bins, minlength=64), np.bincount(bins, weights=seen, minlength=64)
        out["batch"].append(-1)
        out["counts"].append(None)
        out["bins"].append(None)
        out["stats"].append([*map(float, types), *map(float, tokens), float((seen == 1).sum()), float((seen == 2).sum())])
        out["gram"] += [int(gram)] * (len(sizes) + 1)
        out["bucket"] += rows.column("bucket").to_pylist() + [rows.column("bucket")[0].as_py()]
    return pa.Table.from_pydict(out, schema=_arrow(_REPLY))


class Weights:
    """The automaton's weights, from the corpus's statistics by n-gram length (all of fixed size)."""

    def __init__(self, stats: dict[int, list[float]]):
        types, tokens = (np.array(stats[1][k : k + 64]) for k in (0, 64))
        self.n, self.v = int(round(tokens.sum())), int(round(types.sum()))
        self.discount, self.exponent = {}, {}
        for level in range(2, ORDER + 1):
            types, tokens = (np.array(stats[level - 1][k : k + 64]) for k in (0, 64))
            there, once, twice = sum(stats[level][:64]), stats[level][128], stats[level][129]
            self.discount[level] = once / (once + 2 * twice) if once else 0.5
            mean = tokens[types > 0] / types[types > 0]
            lo, hi = 0.0, 1.0
            for _ in range(50):  # the exponent whose vocabulary law gives as many n-grams as there are
                a = (lo + hi) / 2
                lo, hi = (a, hi) if (types[types > 0] * mean**a).sum() < there else (lo, a)
            self.exponent[level] = a

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 1.0) / (self.n + self.v + 1.0)

    def failure(self, level: int, c: np.ndarray) -> np.ndarray:
        """The weight of the failure arc of a state of ``level`` - 1 words that was seen c times."""
        return np.clip(self.discount[level] * np.maximum(c, 1.0) ** (self.exponent[level] - 1), 1e-9, 1 - 1e-9)


class Automaton:
    """The states and arcs that a batch's texts can reach.

    An arc is known by its n-gram: ``arc[n]`` says which of the batch's n-grams are arcs from states of n - 1 words,
    ``weight[n]`` has their log10 weights, ``fail[n]`` the log10 weights of the failure arcs of these states.
    """

    def __init__(self, batch: _Batch, totals: dict[int, np.ndarray], weights: Weights):
        c1, c2, c3 = (totals[g] for g in (1, 2, 3))
        root = weights.unigram(c1)
        fail2, fail3 = weights.failure(2, c1), weights.failure(3, c2)
        left = batch.left
        p2 = (1 - fail2[left]) * c2 / np.maximum(c1[left], 1) + np.where(c1[left] > 0, fail2[left], 1.0) * root[batch.right]
        p3 = (1 - fail3[batch.head]) * c3 / np.maximum(c2[batch.head], 1) + fail3[batch.head] * p2[batch.tail]
        self.batch = batch
        self.arc = {1: np.ones(len(c1), bool), 2: c2 > 0, 3: c3 > 0}
        self.weight = {1: np.log10(root), 2: np.log10(p2), 3: np.log10(p3)}
        self.fail = {2: np.log10(fail2), 3: np.log10(fail3)}
        self.state = {2: c1 > 0, 3: c2 > 0}  # which words and pairs are states

    def traverse(self) -> np.ndarray:
        """What each token adds: all texts side by side, every token from the state that the one before leads to."""
        batch = self.batch
        n = len(batch.tokens)
        out = np.zeros(n)
        # The state before a token: the pair before it if that is a state, else the word, else the root. A text
        # begins in the state of the end token.
        before = {2: np.zeros(n, np.int64), 3: np.full(n, -1)}
        before[2][1:], before[3][1:] = batch.tokens[:-1], batch.of[2][:-1]
        before[2][batch.starts], before[3][batch.starts] = 0, -1
        looking = np.arange(n)
        for level in range(ORDER, 1, -1):
            context = before[level][looking]
            here = np.flatnonzero(context >= 0)
            here = here[self.state[level][context[here]]]
            gram = batch.of[level][looking[here]]
            arc = self.arc[level][gram]
            out[looking[here[arc]]] += self.weight[level][gram[arc]]
            out[looking[here[~arc]]] += self.fail[level][context[here[~arc]]]
            looking = np.delete(looking, here[arc])
        out[looking] += self.weight[1][batch.tokens[looking]]
        return out


def _traverse(weights: Weights, key_bits: int):
    def score(layout: pa.Table, replies: pa.Table) -> pa.Table:
        if not layout.num_rows:
            return pa.Table.from_pydict({k: [] for k in _arrow(_RESULT).names}, schema=_arrow(_RESULT))
        row = layout.to_pylist()[0]
        batch = _Batch(row["lens"], row["words"], row["tokens"], key_bits)
        totals = {}
        replies = replies.select(["gram", "bucket", "counts"]).sort_by([("gram", "ascending"), ("bucket", "ascending")])
        grams = replies.column("gram").to_numpy()
        for gram, order in batch.order.items():
            answers = replies.column("counts").filter(pa.array(grams == gram))
            totals[gram] = np.zeros(len(order), np.int64)
            if len(answers):
                totals[gram][order] = np.concatenate([unpack(a.as_py()) for a in answers])
        added = Automaton(batch, totals, weights).traverse()
        base = np.log10(weights.unigram(totals[1]))[batch.tokens]
        known = (totals[1] > 0)[batch.tokens]
        out = {
            "doc_id": row["ids"], "held_out": row["held"], "n_tokens": batch.lens,
            "n_known": np.add.reduceat(known.astype(np.int64), batch.starts),
            "train_tokens": np.full(len(batch.lens), weights.n), "base_score": np.add.reduceat(base, batch.starts),
            "score": np.add.reduceat(added, batch.starts),
        }
        return pa.Table.from_pydict(out, schema=_arrow(_RESULT))

    return score


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def backoff_scores(docs: DataFrame, held_out=None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Score every text with a backoff automaton learnt from the rows that aren't held out.

    ``held_out``: a boolean column (null counts as false); none: all rows are for training.
    Null and empty texts are one end token; a text of any length is one row of a batch. Repeated rows count as
    often as they stand there, and equal texts get equal scores. A null id stays null. Without training rows counts
    are 0 and every token is unknown; a table without rows gives none. Other columns of ``docs``, of any name, are
    not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held"))
    layouts = scratch.table(rows.mapInArrow(frugal(_layouts), _LAYOUT))
    n_tokens = layouts.agg(F.sum("n_tokens")).first()[0] or 0
    bucket_bits = int(math.log2(pow2_at_least(max(16, n_tokens / BUCKET_TOKENS))))
    key_bits = min(64, int(math.log2(ORDER * n_tokens + 1)) + 1 + SPARE_BITS)
    sent = layouts.select("lens", "words", "tokens", "held", "batch").mapInArrow(frugal(_messages(bucket_bits, key_bits)), _MESSAGE)
    replies = scratch.table(sent.groupBy("bucket").applyInArrow(frugal_group(_bucket_totals), _REPLY))
    stats = (
        replies.where("batch = -1").groupBy("gram")
        .agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(130)]).alias("stats")).collect()
    )
    by_gram = {g: [0.0] * 130 for g in range(1, ORDER + 1)} | {r["gram"]: r["stats"] for r in stats}
    answers = replies.where("batch >= 0").select("batch", "gram", "bucket", "counts")
    return layouts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(frugal_cogroup(_traverse(Weights(by_gram), key_bits)), _RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return backoff_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
