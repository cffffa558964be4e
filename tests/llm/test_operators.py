"""The operators on small tables, against brute force where SQL doesn't hold them, and their edge cases."""

import math
import random
import re
from collections import Counter
from pathlib import Path
from zlib import crc32

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillmark.llm import decontamination, html_extraction, lm_scoring, mixing, near_duplicates, quality_rules, quotations, sharding, toxicity, url_filter
from quillmark.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    df, found = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    key = lambda rows, names: sorted((tuple(r[names.index(c)] for c in columns) for r in rows), key=repr)
    assert key(df.collect(), df.columns) == key(found.fetchall(), found.columns)


def test_base_score_by_brute_force(spark, docs):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {d.doc_id: [*WORD.findall(lower(d.text)), None] for d in docs}
    train = Counter(t for i, ts in tokens.items() if crc32(str(i).encode()) % 7 != 2 for t in ts)
    n, v = sum(train.values()), len(train)
    rows = QUERIES["op1_lm_scoring"](spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the model beats the base
    for r in rows:
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc32(str(r.doc_id).encode()) % 7 == 2, len(ts), n)
        assert r.n_known == sum(train[t] > 0 for t in ts)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)


def test_near_duplicates_by_brute_force(spark, docs):
    def shingles(text):
        words = (text or "").split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(d.doc_id, shingles(d.text), d.text or "") for d in docs]
    links, up = Counter(), {i: i for i, _, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a, t) in enumerate(sets):
        for j, b, u in sets[k + 1 :]:
            if t == u or (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                up[y] = x
    found = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op10_near_duplicates"](spark, SF).collect()}
    assert found == {i: (root(i), links[i]) for i, _, _ in sets}


def test_one_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (3, text + " more"), (4, "other words"), (5, None), (6, ""), (None, text)]
    kept = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 3 and sum((r.text or "").startswith("w0") for r in kept) == 1


def test_myers_by_brute_force():
    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return min(row)

    rng = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (12, 30))
        assert decontamination.myers(p, t)[0] == distance(p, t)


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog and then it sleeps all day long"
    near = item.replace("fox", "fix").upper()
    docs = spark.createDataFrame([(1, f"before {near} after"), (2, "clean text"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontamination.find_items(docs, items).collect()] == [(1, 7, 1)]
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()} == {2, 3, 4}
    assert decontamination.drop_contaminated(docs, items.limit(0)).count() == 4


def test_shards(spark, docs):
    rows = QUERIES["op7_sharding"](spark, SF).collect()
    size = {d.doc_id: len((d.text or "").encode()) + 1 for d in docs}
    assert len(rows) == len(docs) and all(r.size == size[r.doc_id] and r.law == "bytes" for r in rows)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))


def test_equal_texts_share_a_shard(spark):
    """Each splitter is held against all places where it could stand: it is within the tolerance, or at the nearer end of a large text."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    copies = docs + [d for d in docs if d.doc_id % 10 == 3 for _ in range(4)]
    table = spark.createDataFrame([(k, d.text, d.lang, d.source, d.n_chars) for k, d in enumerate(copies)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = sharding.stage(spark, table.repartition(3), sf).select("text", "shard").collect()
    size = lambda t: len((t or "").encode()) + 1
    share = sum(size(r.text) for r in rows) / sharding.SHARDS
    shards, texts = Counter(), {}
    for r in rows:
        shards[r.shard] += size(r.text)
        texts.setdefault(r.text, []).append(r.shard)
    split = [t for t, found in texts.items() if len(set(found)) > 1]
    assert all(size(t) * len(texts[t]) > 2 * max(sharding.GROUP_TOLERANCE * share, *(size(r.text) for r in rows)) for t in split)
    assert len(shards) == sharding.SHARDS and all(abs(n - share) <= 2 * (sharding.GROUP_TOLERANCE * share + max(size(r.text) for r in rows)) for n in shards.values())


def test_mixing_is_bounded_and_repeats(spark):
    first, again = (sorted(map(tuple, QUERIES["op4_mixing"](spark, SF).collect())) for _ in range(2))
    assert first == again and all(taken <= 2 * size for _, size, _, _, taken in first)


def test_toxicity_finds_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = QUERIES["op2_toxicity"](spark, SF.replace("0.001", "0.01")).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(p == t for p, t in held) >= 0.9 * len(held)


def test_quotations(spark):
    said = "a remark that is long enough to be quoted by someone else"
    rows = [(1, 0, "u", said), (1, 1, "v", f"> {said}\n\nI agree."), (1, 2, "u", None), (2, 0, "u", "")]
    found = {(r.conv_id, r.turn): r for r in quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1, 1].reply_to == 0 and found[1, 1].text.strip() == "I agree." and len(found) == 4


def test_extraction(spark):
    html = "<html><head><script>x()</script></head><body><nav><a href='/'>Home</a></nav><article><p>One &amp;  two</p><p>Three</p></article><footer>Imprint</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://a.net/1", html), (2, None, None), (3, "http://a.net/3", "")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extract_text(pages).collect()} == {1: "One & two\nThree", 2: "", 3: ""}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert lm_scoring.backoff_scores(docs).count() == 0
    assert near_duplicates.near_duplicates(docs).count() == 0
    assert quality_rules.quality_cascade(docs).count() == 0
    assert mixing.mix(docs, F.lit(0)).count() == 0
    assert sharding.stage(spark, docs, SF).count() == 0
    assert toxicity.score(docs, [], []).count() == 0
    assert html_extraction.extract_text(pages).count() == 0
    assert url_filter.url_verdicts(pages.select("page_id", "url")).count() == 0
    assert quotations.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    assert set(rows.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} and rows.count() > 0
