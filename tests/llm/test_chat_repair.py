"""Cheapest edits against all edits of small conversations; shared layers; edge cases. SQL holds the query."""

import random
import re
from functools import lru_cache
from hashlib import sha256

from pyspark.sql import functions as F

from quillmark.llm import chat_repair

EMPTY = sha256(b"").hexdigest()


def cheapest(signature):
    """(cost, edits) by trying all edits, with two inserts in a row at most, against the pattern itself."""
    legal = re.compile(r"(s?(ua)+)?")

    @lru_cache(None)
    def tried(at, roles, inserted):
        found = [(0, "")] if at == len(signature) and legal.fullmatch(roles) else []
        steps = [("I", 3, at, r) for r in "ua"] if inserted < 2 else []
        if at < len(signature):
            letter = signature[at]
            steps.append(("D", 4, at + 1, ""))
            if letter != "d":
                more = 3 * letter.isupper()
                steps += [("R", 3 + more, at + 1, r) for r in "ua"] + [("K", more, at + 1, letter.lower())]
        for edit, cost, to, role in steps:
            if not re.fullmatch(r"s?(ua)*u?", roles + role):
                continue
            rest = tried(to, roles + role, inserted + 1 if edit == "I" else 0)
            if rest:
                found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    return tried(0, "", 0)


def test_edits_by_brute_force():
    draw = random.Random(3)
    signatures = sorted({"".join(draw.choices("suaoSUAOd", k=draw.randrange(7))) for _ in range(250)}, key=lambda s: s[::-1])
    trie = chat_repair.Trie()
    for signature in signatures:
        assert trie.solve(signature) == cheapest(signature), signature
    assert trie.layers < sum(map(len, signatures))
    assert [chat_repair.Trie().solve(s) for s in signatures] == [cheapest(s) for s in signatures]


def test_layers_are_shared():
    trie = chat_repair.Trie()
    for k in range(100):
        trie.solve("u" * k + "ua" * 50)
    assert trie.layers == 100 + 99


def test_a_long_conversation():
    cost, audit = chat_repair.Trie().solve("ua" * 100_000 + "u")
    assert (cost, len(audit)) == (3, 200_002)


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 5, "user", "Hi?"), (1, 5, "assistant", "No end"),
    (2, None, "tool", "x."), (2, 3, "user", " \t"), (None, 1, "assistant", "Null."), (None, 2, "", "No role."), (None, None, "user", "First!"), (4, 1, "user", "y" * 300_000 + "."),
]


def test_edge_cases(spark):
    rows = spark.createDataFrame([(*r, 0) for r in ROWS], "conv_id long, turn long, role string, text string, copy int")
    rows = rows.withColumns({c: F.lit("user") for c in ("place", "fault", "letter", "audit", "signature", "cost")}).repartition(3)
    everyone = spark.createDataFrame([(1,), (1,), (9,)], "conv_id long")
    found = {r.conv_id: tuple(r)[1:] for r in chat_repair.repair(rows, everyone).collect()}
    digest = lambda *lines: sha256("\n".join(lines).encode()).hexdigest()
    assert found == {
        1: (3, 0, 1, 1, 0, 7, "KKKD", digest("system:Be kind.", "user:Hi?", "assistant:No end")),
        2: (0, 1, 0, 0, 1, 8, "DD", EMPTY),
        None: (0, 0, 0, 0, 1, 4, "KKD", digest("user:First!", "assistant:Null.")),
        4: (0, 0, 0, 0, 0, 3, "KI", digest("user:" + "y" * 300_000 + ".", "assistant:")),
        9: (0, 0, 0, 0, 0, 0, "", EMPTY),
    }
    assert chat_repair.repair(rows.limit(0)).count() == 0 and chat_repair.repair(rows.limit(0), everyone).count() == 2


def test_damage(spark):
    rows = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    row = chat_repair.damage(rows).first()
    assert row is None or (row.role in (" ", "user") and row.text in (" ", ""))
