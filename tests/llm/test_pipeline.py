"""run() against a brute-force version of all its stages."""

import hashlib
import re
from collections import Counter

import duckdb
from conftest import SF

import corpus_pipeline
from quillmark.llm import decontamination, quality_rules


def kept_by_rules():
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.sql(quality_rules.ORACLE_SQL)
    doc_id, kept = found.columns.index("doc_id"), found.columns.index("kept")
    return {r[doc_id] for r in found.fetchall() if r[kept]}


def one_of_each_class(docs):
    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, up = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i for i in ids if root(i) == i}


def clean(docs, items):
    """No pigeonhole: the whole item against the whole text."""
    items = [decontamination.normalise(t) for t in items]
    assert all(len(t) >= decontamination.MIN_CHARS for t in items)
    return {i for i, t in docs.items() if not any(decontamination.myers(x, decontamination.normalise(t))[0] <= int(len(x) * decontamination.MAX_ERROR) for x in items)}


def copies(docs, sources):
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs.items()}
    per = Counter()
    for i, n in sizes.items():
        per[sources[i]] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(per))}
    targets, free = {}, set(per)
    while True:
        level = (1.5 * sum(per.values()) - sum(targets.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * per[s]}
        targets |= {s: 2.0 * per[s] for s in over}
        free -= over
        if not over:
            break
    targets |= {s: weight[s] * level for s in free}
    out = Counter()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for i, t in docs.items():
        rate = targets[sources[i]] / per[sources[i]]
        out[i] = int(rate) + (int(md5(f"{i}:{md5(t)}:0:mix")[:13], 16) / (1 << 52) < rate - int(rate))
    return +out


def test_run_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len({r.doc_id for r in rows}) == len(rows)
    docs, sources = {r.doc_id: r.text or "" for r in rows}, {r.doc_id: r.source for r in rows}
    for choose in (lambda d: kept_by_rules(), one_of_each_class, lambda d: clean(d, items)):
        kept = choose(docs)
        docs = {i: t for i, t in docs.items() if i in kept}
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in found) == copies(docs, sources)
    slots, size = {}, Counter()
    for r in found:
        assert r.text == docs[r.doc_id]
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += len(r.text.encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(Counter({i: n * len(docs[i].encode()) for i, n in Counter(r.doc_id for r in found).items()}).values())
    assert all(abs(n - sum(size.values()) / 16) <= largest + 16 for n in size.values())
