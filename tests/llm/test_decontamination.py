"""Short benchmark items: found unchanged, as whole words."""

import random

from quillmark.llm import decontamination


def test_short_items(spark):
    item = "What is the capital of France?"
    texts = {1: "quiz: what is  the\ncapital of france? Paris.", 2: "What is the capitol of France?", 3: "the catalogue", 4: "a black cat, asleep", 5: "concat", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "Cat"), (9, " "), (10, "")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.distance, r.start, r.stop) for r in decontamination.find_items(docs, items).collect())
    assert found == [(1, 7, 0, 6, 36), (4, 8, 0, 8, 11)]
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()} == {2, 3, 5, 6}


def _items(number, blank, rng):
    """Items of one template, each with its own words in the blank."""
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(blank)) for _ in range(number)]
    return [(n, f"which of the following statements about {w} is correct and why is it so") for n, w in enumerate(words)]


def _damage(text, errors, rng):
    for _ in range(errors):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "#" + text[at + 1 :], text[:at] + "#" + text[at:]])
    return text


def test_many_patterns_together_equal_each_alone():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("abc\0é") for _ in range(rng.randrange(1, 200)))
        patterns = ["".join(rng.choice("abc\0é") for _ in range(rng.randrange(1, 190))) for _ in range(5)]
        assert decontamination.myers_together(patterns, text).tolist() == [decontamination.myers(p, text)[0] for p in patterns]


def test_items_of_a_template_equal_brute_force():
    """Blanks of many sizes, damaged and undamaged, near and far from other items: as if each item were compared with the whole text."""
    rng = random.Random(5)
    for blank in (3, 8, 30):
        items = _items(120, blank, rng)
        index = decontamination.ItemIndex(items, decontamination.MAX_ERROR)
        for _ in range(12):
            parts = [_damage(rng.choice(items)[1], rng.randrange(7), rng) for _ in range(2)]
            text = "An exam: " + parts[0] + " And " + parts[1] + " which of the following statements about nothing"
            expected = {}
            for n, item in items:
                distance = decontamination.myers(item, decontamination.normalise(text))[0]
                if distance <= int(len(item) * decontamination.MAX_ERROR):
                    expected[n] = distance
            assert {n: d for n, d, *_ in index.find(text)} == expected
            assert bool(index.find(text, first_only=True)) == bool(expected)


def test_pieces_lie_apart_and_avoid_the_template():
    rng = random.Random(7)
    items = _items(200, 80, rng)
    counts = decontamination.gram_counts([t for _, t in items])
    for (_, text), c in zip(items, counts):
        k = int(len(text) * decontamination.MAX_ERROR)
        pieces = decontamination.cut(len(text), k, c)
        assert len(pieces) == k + 1 and all(a[1] <= b[0] for a, b in zip(pieces, pieces[1:])) and pieces[0][0] >= 0 and pieces[-1][1] <= len(text)
        assert all(sum(text[lo:hi] in t for _, t in items) <= decontamination.SHARED for lo, hi in pieces)


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_CHARS", 2_000)
    items = _items(200, 30, random.Random(9))
    docs = spark.createDataFrame([(n, "see: " + t) for n, t in items[::7]] + [(-1, "nothing of the kind")], "doc_id long, text string")
    bench = spark.createDataFrame(items + items[:50], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_items(docs, bench).collect()}
    assert found == {(n, n) for n, _ in items[::7]}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()] == [-1]
