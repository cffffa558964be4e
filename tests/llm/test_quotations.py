"""Quotation linking against brute force: nested, short and partial quotations."""

import random

from quillmark.llm import quotations

SHORT = ["Yes.", "No!", "Why?", "I agree.", "Not now..."]


def linked(spark, rows):
    found = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert len(found) == len(rows)
    return {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.position, r.text) for r in found}


def test_short_and_partial_quotations(spark):
    rows = [(1, 0, "u", "Shall we go? I would like to. It is late, though."), (1, 1, "v", "Yes, agreed"), (1, 2, "u", "> Yes, agreed\n\nGood."), (1, 3, "v", "> I would like to.\n\nMe too."), (1, 4, "u", ">> It is late, though.\n> Good.\n\nFine.")]
    assert {k[1]: v[0] for k, v in linked(spark, rows).items()} == {0: None, 1: None, 2: 1, 3: 0, 4: 2}


def test_links_by_brute_force(spark):
    rng = random.Random(9)
    rows, wanted = [], {}
    for conv in range(12):
        pool = [f"Word{i} of {conv} says {'more ' * rng.randint(0, 3)}now." for i in range(8)] + SHORT
        said, parents, owns = [], {}, {}
        for turn in range(10):
            own = [rng.choice(pool) for _ in range(rng.randint(1, 4))]
            quotes = []
            for level in (2, 1):
                if turn and rng.random() < 0.5:
                    of = said[rng.randrange(turn)]
                    first = rng.randrange(len(of))
                    quotes.append((level, of if rng.random() < 0.4 else of[first : first + rng.randint(1, 2)]))
            text = "".join(f"{'>' * level} {' '.join(q)}\n" for level, q in quotes) + "\n" * bool(quotes) + " ".join(own)
            found = []
            for level, q in quotes:
                for piece in {" ".join(q), *q}:
                    by = [t for t, of in enumerate(said) if piece == " ".join(of) or piece in of]
                    if by:
                        found.append((level, -len(piece), -by[0]))
            parents[turn] = -min(found)[2] if found else None
            said.append(own)
            owns[turn] = " ".join(own)
            rows.append((conv, turn, "u", text))
        place = {}
        for turn, parent in parents.items():
            place[turn] = (turn, 0) if parent is None else (place[parent][0], place[parent][1] + 1)
        order = sorted(place, key=lambda t: (place[t][0], t))
        wanted |= {(conv, t): (parents[t], *place[t], order.index(t), owns[t]) for t in place}
    assert sum(v[0] is not None for v in wanted.values()) > 30
    assert linked(spark, rows) == wanted
