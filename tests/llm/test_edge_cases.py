"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for operators and stages."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import decontamination, mixing, near_duplicates, quality_rules, quotations, sharding, toxicity, url_filter
from quillmark.llm.common import mix64, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("_words", "_row", "_alive", "row", "size", "copies", "key", "target", "source_size", "_k1", "_size", "at", "stays", "f1", "own", "uid", "label", "place", "n", "_n")
LONG = " ".join(f"w{i}" for i in range(150_000))
PROSE = " ".join(f"word{i}" for i in range(80))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, None, None, None, None), (None, PROSE, "en", None, 1), (None, PROSE, "en", None, 1), (1, "", "en", "a", 0), (2, LONG, "en", "a", 9),
            (3, PROSE, "en", "b", 7), (3, PROSE, "en", "b", 7), (3, PROSE + " more", "de", "b", 8), (4, " \t\n", "en", "b", 3)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(f"user {n}") for n in NAMES}).repartition(3)


def counted(rows):
    return Counter(tuple(str(v)[:90] for v in r) for r in rows)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "an item that is nowhere to be found in any of these texts"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, tables, name, stage):
    out = stage(spark, docs, tables)
    assert out.columns[: len(docs.columns)] == docs.columns
    found, given = counted(r[: len(docs.columns)] for r in out.collect()), counted(docs.collect())
    assert set(found) <= set(given)
    kept = {"quality_rules": 6, "near_duplicates": 3, "decontamination": 9, "sharding": 9}.get(name)
    assert kept is None or found.total() == kept
    if name == "decontamination" or name == "sharding":
        assert found == given
    assert stage(spark, docs.limit(0), tables).count() == 0
    assert counted(r[: len(docs.columns)] for r in stage(spark, docs.repartition(2), tables).select(*[f"`{c}`" for c in docs.columns]).collect()).keys() == found.keys()


def test_quality_rules(spark, docs):
    rows = quality_rules.quality_cascade(docs, report=True).collect()
    assert len(rows) == 9 and all(r["_words"] == "user _words" for r in rows)
    assert sorted((r.n_words, r.kept) for r in rows) == sorted([(0, False)] * 3 + [(80, True)] * 4 + [(81, True), (150_000, True)])


def test_rule_order_follows_rejection_per_cost():
    rules = quality_rules.RULES
    k = {r.name: i for i, r in enumerate(rules)}
    amounts = {"rows": 100.0, "chars": 100_000.0, "words": 20_000.0, "lines": 1000.0}
    order = quality_rules.greedy_order(rules, {0: 50, 1 << k["shouts"]: 30, 1 << k["repeats"]: 20}, amounts)
    assert [r.name for r in order[:2]] == ["shouts", "repeats"] and sorted(r.name for r in order) == sorted(k)
    # Rows that an earlier rule rejects don't count again.
    order = quality_rules.greedy_order(rules, {1 << k["shouts"] | 1 << k["repeats"]: 30, 1 << k["symbols"]: 1}, amounts)
    assert [r.name for r in order[:2]] == ["shouts", "symbols"]


def test_mixing_agrees_over_other_files(spark):
    """Many rows equal in id and text, over sources whose rates have fractions, laid out in three ways."""
    rows = [(k % 3, f"text {k % 4}", "en", ("a", "b", "c", None)[k % 4 if k % 7 else 1], k % 5) for k in range(900)] + [(1000 + k, f"one {k}", "en", "b", 0) for k in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [counted(mixing.mix(d, F.lit(2).cast("long")).select("row.*", "copies").collect()) for d in (docs.coalesce(1), docs.repartition(5), docs.orderBy(F.desc("n_chars"), F.rand(3)))]
    assert found[0] == found[1] == found[2] and found[0].total() == len(rows)
    taken = [sum(n * int(r[-1]) for r, n in found[0].items() if r[3] == s) for s in ("a", "b", "c", "None")]
    sizes = [sum(r[3] == s for r in rows) for s in ("a", "b", "c", None)]
    assert all(0 < t <= 2 * n for t, n in zip(taken, sizes))


def test_mixing_near_targets_with_null_and_repeated_ids(spark):
    sources = [F.lit(None), F.lit(7), F.col("id")]
    for doc_id in sources:
        docs = spark.range(6000).select(doc_id.cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit("one two three").alias("text"))
        out = mixing.mix(docs, F.lit(3).cast("long")).select("row.source", "target", (F.col("size") * F.col("copies")).alias("taken"))
        per = out.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
        assert len(per) == 3 and all(r.n == 2000 and abs(r.taken - r.target) <= 0.05 * r.target for r in per)
        assert math.isclose(sum(r.target for r in per), 1.5 * 18_000)


def test_mixing_targets_by_brute_force(spark):
    sizes = {"b": 10, None: 1000, "a": 500, "c": 0, "é": 3, "Z": 700}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), mixing.Scratch(spark, "test")).collect()
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate([*sorted(s for s in sizes if s is not None), None])}
    targets, free = {}, set(sizes)
    while True:
        level = (1.5 * sum(sizes.values()) - sum(targets.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        targets |= {s: 2.0 * sizes[s] for s in over}
        free -= over
        if not over:
            break
    targets |= {s: weight[s] * level for s in free}
    assert {r.source: r.target for r in rows} == targets


def test_shards_are_balanced_and_keep_equal_texts_together(spark):
    text = F.concat_ws(" ", F.lit("text"), F.when(F.col("id") % 3 == 0, F.lit("copied")).otherwise((F.col("id") % 4001).cast("string")), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))
    docs = spark.range(40_000).select(F.when(F.col("id") % 11 > 0, F.col("id")).alias("doc_id"), text.alias("text")).repartition(5)
    rows = sharding.stage(spark, docs, "").collect()
    size, slots, shards_of = Counter(), {}, {}
    for r in rows:
        size[r.shard] += len(r.text) + 1
        slots.setdefault(r.shard, []).append(r.slot)
        shards_of.setdefault(r.text, set()).add(r.shard)
    mean = sum(size.values()) / 16
    assert len(rows) == 40_000 and set(size) == set(range(16)) and all(abs(n - mean) <= 0.02 * mean for n in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in shards_of.values()) <= 15
    again = sharding.stage(spark, docs.repartition(3), "").collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in again) == Counter((r.doc_id, r.text, r.shard) for r in rows)


def test_decontamination_by_brute_force(spark):
    import random

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return min(row)

    rng = random.Random(4)
    words = [f"{a}{b}r" for a in "bcd" for b in "aeiou"]
    items = {k: " ".join(rng.choice(words) for _ in range(rng.randint(9, 16))) for k in range(8)}
    texts = {}
    for k in range(40):
        parts = [rng.choice(words) for _ in range(30)]
        for _ in range(rng.randint(0, 2)):
            item = list(rng.choice(list(items.values())))
            for _ in range(rng.randint(0, 5)):
                item[rng.randrange(len(item))] = rng.choice(["", "x", "bo"])
            parts.insert(rng.randrange(30), "".join(item))
        texts[k] = " ".join(" ".join(parts).split())
    found = decontamination.find_items(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    wanted = {}
    for d, t in texts.items():
        for i, item in items.items():
            if (n := distance(item, t)) <= int(0.06 * len(item)):
                wanted[d, i] = n
    assert {(r.doc_id, r.item_id): r.distance for r in found} == wanted and len(wanted) > 10
    for r in found:  # the span given is at that distance
        span = texts[r.doc_id][r.start : r.stop]
        assert abs(len(span) - r.item_chars) <= r.distance and distance(items[r.item_id], span) == r.distance


def test_decontamination_in_passes(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, PROSE[:200]), (2, "word3 word4"), (3, None), (4, ""), (5, LONG[-4000:]), (6, PROSE[:200])], "item_id long, text string")
    one = counted(decontamination.find_items(docs, items).collect())
    monkeypatch.setattr(decontamination, "PASS_CHARS", 150)
    assert counted(decontamination.find_items(docs, items).collect()) == one and one.total() == 5 * 3 + 1
    assert decontamination.find_items(docs, items.limit(0)).count() == 0 and decontamination.find_items(docs.limit(0), items).count() == 0


def test_near_duplicates_do_not_depend_on_files(spark, docs):
    rows = lambda d: Counter((r.doc_id, r.class_id, r.n_links, r.stays) for r in near_duplicates.near_duplicates(d).collect())
    found = rows(docs)
    assert found == rows(docs.repartition(7)) == rows(docs.coalesce(1)) and found.total() == 9
    assert found[3, 3, 4, False] + found[3, 3, 4, True] == 3 and found[2, 2, 0, True] == 1 and found[None, 1, 2, False] == 1
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_recall_of_near_duplicates(spark):
    """Every pair of the queries (ids divisible by 20) with all rows, against brute force."""
    import random

    rng = random.Random(8)
    texts = []
    for _ in range(150):
        base = [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"t{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    found = {r.doc_id: r.n_links for r in near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    there = here = 0
    for q in range(0, len(texts), 20):
        n = sum(k != q and 5 * len(sets[q] & s) >= 4 * len(sets[q] | s) for k, s in enumerate(sets))
        there, here = there + n, here + min(n, found[q])
        assert found[q] <= n
    assert there > 25 and here >= 0.9 * there


def test_expected_recall_decides_the_depth():
    at = lambda depth, agreed: near_duplicates.expected_recall(depth, 0.8, agreed)
    assert at(10, {}) < at(9, {}) < at(8, {}) < 1
    assert at(10, {256: 1000}) < at(10, {270: 1000}) and at(10, {310: 1000}) == at(10, {})


def test_toxicity_against_a_plain_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["good", "bad", "Fine", "ugly", "day"]) for _ in range(rng.randint(0, 9)))) for k in range(300)] + [(300, None)]
    labels = [(k, int("bad" in (t or ""))) for k, t in rows]
    coordinates, weights = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), epochs=2)
    hashed = lambda w: word_hashes([w.encode()])
    mask = np.uint64((1 << toxicity.BITS) - 1)

    def features(text):
        words = (text or "").lower().split()
        out = {0} | {int((mix64(hashed(w)) & mask)[0]) for w in words}
        for gap in (1, 2, 3):
            out |= {int((mix64(hashed(a) * np.uint64(2 * gap + 1) + hashed(b)) & mask)[0]) for a, b in zip(words, words[gap:])}
        return out

    order = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.xxhash64("doc_id")).collect()
    z, n, truth = Counter(), Counter(), dict(labels)
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / (toxicity.BETA + math.sqrt(n[i])) * toxicity.ALPHA
    for _ in range(2):
        for r in order:
            at = features(r.text)
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - truth[r.doc_id]
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    wanted = {i: weight(i) for i in z if weight(i)}
    assert len(wanted) > 5 and set(coordinates) == set(wanted) and all(math.isclose(v, wanted[i], rel_tol=1e-9) for i, v in zip(coordinates, weights))
    scored = toxicity.score(spark.createDataFrame(rows + rows[:1], "doc_id long, text string"), coordinates, weights).collect()
    for r, (_, text) in zip(sorted(scored, key=lambda r: r.doc_id), sorted(rows + rows[:1], key=lambda r: r[0])):
        assert math.isclose(r.score, 1 / (1 + math.exp(-sum(wanted.get(i, 0) for i in features(text)))), rel_tol=1e-5)


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "https://x.example.net/en/1?x", "https://example.net/enx", "http://www.example.com/de/#f", "http://a.org/fr/", "http://notorg/fr/", "http://a.org/" + "fr/" * 100_000]
    rows = [(k, u, "user") for k, u in enumerate(urls)] + [(1, "", "user")]
    df = spark.createDataFrame(rows, "page_id long, url string, k string").withColumn("host", F.lit("user"))
    wanted = [(None, "allow")] * 4 + [(None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow")]
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(df).collect()}
    assert [found[k] for k in range(10)] == wanted and found[10] == ("org/fr/", "allow")
    assert url_filter.url_verdicts(df.limit(0)).count() == 0
    # Digests that collide are told apart by the strings.
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: 5)
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(url_filter.RuleIndex.build([("a", "/", "block"), ("b", "/", "allow")]))
        f.flush()
        index = url_filter.RuleIndex(f.name)
        hits = index.probe([b"a\x00/", b"c\x00/", b"b\x00/"])
        assert [index.string(h) if h >= 0 else None for h in hits] == [b"a\x00/", None, b"b\x00/"]


def test_quotations(spark):
    rows = [(None, 0, "u", "hello there"), (None, 1, "u", "> hello there\n\nyes"), (1, 0, None, None), (1, 0, None, None), (1, 1, "u", ""), (1, None, "u", "x"), (2, 0, "u", LONG), (2, 1, "v", f"> {LONG}\n\nlong")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("user") for n in ("uid", "own", "quotes", "position", "root")})
    found = quotations.link_quotations(df).collect()
    assert len(found) == 8 and [r.reply_to for r in found if r.conv_id == 2 and r.turn == 1] == [0]
    assert sorted(r.position for r in found if r.conv_id == 1) == [0, 1, 2, 3] and all(r.reply_to is None for r in found if r.conv_id is None)
    assert quotations.link_quotations(df.limit(0)).count() == 0
