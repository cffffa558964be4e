"""The traversal and the manifest against whole trees, and edge cases; SQL holds the query."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillmark.llm import merkle


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([merkle.run_digest(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, leaf):
    found = []
    for nodes in levels[:-1]:
        begin = leaf - leaf % 3
        found.append((nodes[begin:leaf], nodes[leaf + 1 : begin + 3]))
        leaf //= 3
    return found


@pytest.mark.parametrize("height", [1, 2, 3, 5])
def test_traversal(height):
    for n in [*range(1, 31), 80, 81, 82, 243, 250]:
        leaves = [sha256(str(k).encode()).digest() for k in range(n)]
        levels = tree_of(leaves)
        assert merkle.levels_above(n) == len(levels) - 1 and merkle.block_root(leaves, len(levels) - 1) == levels[-1][0]
        for k, path in enumerate(merkle.traverse(leaves, len(levels) - 1, height)):
            assert path == path_of(levels, k) == merkle.unpack_path(merkle.pack_path(path))
            assert merkle.fold(leaves[k], path) == levels[-1][0]


def test_traversal_keeps_few_nodes():
    """Of 3^7 leaves, subtrees of 2 levels: no more than the existing and the desired ones and an open run a level."""
    leaves = [k.to_bytes(32, "big") for k in range(3**7)]
    bounds = [(0, 2), (2, 4), (4, 6), (6, 7)]
    kept = sum(len(level) for low, high in bounds for level in merkle.Growing(leaves, 0, low, high).finish().nodes)
    assert kept <= 12 * len(bounds)


def leaf_of(row):
    shown = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)
    return sha256(shown.encode()).digest()


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_by_brute_force(spark, levels):
    """Many tiers (small blocks), null and empty sources, null ids, ties, repeated rows, a source of one row, long texts."""
    draw = random.Random(5)
    rows = [(k if k % 9 else None, draw.choice(["a", "b", "é", "", None]), "x\ny" if k % 4 else None) for k in range(120)]
    rows += [(7, "a", "tie"), (7, "a", "another tie"), (7, "a", "tie"), (1, "alone", "z"), (2, "long", "w " * 300_000)]
    docs = spark.createDataFrame(rows, "id long, s string, t string").withColumns({c: F.lit("user") for c in ("tree", "rank", "node", "_at", "o0", "root")}).repartition(4)
    probe = merkle.leaf_digest(F.col("id"), F.col("s"), F.regexp_replace("t", "\n", ""))
    found = merkle.manifest(docs, "s", ["id"], merkle.leaf_digest(F.col("id"), F.col("s"), F.col("t")), ["id", "s"], probe, levels)
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    wanted, built = [], {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[name] = tree_of([leaf_of(r) for r in trees[name]])
    over = tree_of([built[n][-1][0] for n in names])
    for at, name in enumerate(names):
        for k, row in enumerate(trees[name]):
            path = path_of(built[name], k) + path_of(over, at)
            folded = merkle.fold(leaf_of((*row[:2], row[2] and row[2].replace("\n", ""))), path)
            wanted.append((row[0], name, leaf_of(row).hex(), built[name][-1][0].hex(), over[-1][0].hex(), merkle.proof_digest(path), folded.hex(), folded == over[-1][0]))
    assert Counter(map(tuple, found.collect())) == Counter(wanted)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, s string")
    leaf = merkle.leaf_digest(F.col("id"), F.col("s"))
    row = merkle.manifest(docs, "s", ["id"], leaf, ["id"]).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha256(b"").hexdigest()
    assert merkle.manifest(docs.limit(0), "s", ["id"], leaf, ["id"]).count() == 0
