"""The score of every text against a backoff model in plain dicts."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from quillmark.llm import lm_scoring


def model(texts, held):
    """Counts by n-gram length over the training texts, and the weights that follow from them."""
    counts = {n: Counter() for n in (1, 2, 3)}
    for text, out in zip(texts, held):
        tokens = [*(text or "").encode().lower().split(), None]
        before = ["<s>"]
        for t in tokens if not out else ():
            for n in (1, 2, 3):
                if len(before) >= n - 1:
                    counts[n][(*before[len(before) - n + 1 :], t)] += 1
            before.append(t)
    stats = {}
    for n, c in counts.items():
        bins = np.zeros(130)
        for k in c.values():
            bins[int(math.log2(k))] += 1
            bins[64 + int(math.log2(k))] += k
        bins[128], bins[129] = (sum(k == j for k in c.values()) for j in (1, 2))
        stats[n] = list(bins)
    return counts, lm_scoring.Weights(stats)


def probability(counts, weights, context, word):
    if not context:
        return (counts[1][word,] + 1) / (weights.n + weights.v + 1)
    seen = counts[1][None,] if context == ("<s>",) else counts[len(context)][context]
    shorter = probability(counts, weights, context[1:], word)
    if not seen:
        return shorter
    fail = float(weights.failure(len(context) + 1, np.array([seen]))[0])
    return (1 - fail) * counts[len(context) + 1][*context, word] / seen + fail * shorter


def brute_force(texts, held):
    counts, weights = model(texts, held)
    for text in texts:
        before, total = ["<s>"], 0.0
        for word in [*(text or "").encode().lower().split(), None]:
            total += math.log10(probability(counts, weights, tuple(before[-2:]), word))
            before.append(word)
        yield total


def test_score_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH_TOKENS", 5_000)
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    found = {r.doc_id: r.score for r in lm_scoring.query(spark, SF).collect()}
    for row, score in zip(rows, brute_force([r.text for r in rows], held)):
        assert math.isclose(found[row.doc_id], score, rel_tol=1e-9), row.doc_id


def test_a_state_spreads_all_its_weight():
    texts = ["a b a b c", "a b b", "c a", None]
    counts, weights = model(texts, [False] * 4)
    vocabulary = [b"a", b"b", b"c", None]
    for context in [(b"a",), (b"a", b"b"), ("<s>", b"a"), (b"b", b"b"), ("<s>",)]:
        known = sum(probability(counts, weights, context, w) for w in vocabulary)
        unseen = probability(counts, weights, context, b"z")
        assert math.isclose(known + unseen, 1.0, rel_tol=1e-9)


def test_edge_cases(spark):
    long = "x y z " * 100_000
    rows = [(1, None, "a"), (None, "", "b"), (2, long, "c"), (3, "q r", "d"), (3, "q r", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch string").withColumns({"score": F.lit(0), "tokens": F.lit(0), "held": F.lit("x")})
    found = lm_scoring.backoff_scores(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 1), (1, 1), (2, 300_001), (3, 3), (3, 3)]
    assert len({r.score for r in found if r.doc_id == 3}) == 1 and len({r.score for r in found if r.n_tokens == 1}) == 1
    for r, wanted in zip(sorted(found, key=lambda r: r.doc_id or 0), brute_force(["", None, long, "q r", "q r"], [False] * 5)):
        assert math.isclose(r.score, wanted, rel_tol=1e-9)
    all_held = lm_scoring.backoff_scores(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in all_held} == {0} and all(r.n_known == 0 and r.score == r.base_score for r in all_held)
