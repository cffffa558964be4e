"""A Merkle manifest of a dataset: a digest for every row, a tree for every source, one root.

A run of three nodes has as its parent the digest of their digests. A tree is cut into aligned blocks of 3^7 nodes;
blocks are digested where they lie, their roots are the nodes of the next tier, and so on until one block holds a
tree. Proofs come back down the tiers: in each block a fractal traversal emits the nodes' authentication paths one after
the other, and the proof of the block itself, which one row brings along, is appended. So a task holds one block, and
neither a hot source nor the number of sources gathers anywhere.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, ranked

ARITY = 3
#: Levels of a block: it has ARITY ** BLOCK_LEVELS nodes at most.
BLOCK_LEVELS = 7
#: Levels of one subtree that a traversal keeps whole.
STACKED_LEVELS = 3


def run_digest(nodes: list[bytes]) -> bytes:
    """The parent of a run: the digest of the digests as hexadecimal text."""
    return sha256(b"".join([n.hex().encode() for n in nodes])).digest()


def levels_above(n: int) -> int:
    """How often ``n`` nodes are gathered in runs until one is left."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


class Growing:
    """A subtree that takes one leaf at a time; it keeps the nodes of its levels from ``low`` to below ``high`` and an open run a level."""

    def __init__(self, leaves: list[bytes], number: int, low: int, high: int):
        width = ARITY**high
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.stop = number * width, min(len(leaves), (number + 1) * width)
        self.first = number * width
        self.nodes: list[list[bytes]] = [[] for _ in range(high - low)]
        self.runs: list[list[bytes]] = [[] for _ in range(high)]
        self.root: bytes | None = None

    def _put(self, level: int, node: bytes) -> None:
        if level >= self.low and level < self.high:
            self.nodes[level - self.low].append(node)
        if level == self.high:
            self.root = node
        else:
            self.runs[level].append(node)

    def step(self) -> None:
        """Take the next leaf, if there is one."""
        if self.at >= self.stop:
            return
        self._put(0, self.leaves[self.at])
        self.at += 1
        ended = self.at == self.stop
        for level, run in enumerate(self.runs):
            if len(run) == ARITY or ended and run:
                self.runs[level] = []
                self._put(level + 1, run_digest(run))
            elif not ended:
                break

    def finish(self) -> Growing:
        while self.at < self.stop:
            self.step()
        return self

    def siblings(self, leaf: int, level: int) -> tuple[list[bytes], list[bytes]]:
        """The other nodes of the run above ``leaf`` at a level: those to the left and those to the right."""
        at = (leaf - self.first) // ARITY**level
        begin = at - at % ARITY
        run = self.nodes[level - self.low]
        return run[begin:at], run[at + 1 : begin + ARITY]


def traverse(leaves: list[bytes], levels: int, height: int = STACKED_LEVELS):
    """The authentication path of every leaf in turn: for each of ``levels`` levels, the siblings left and right.

    Subtrees of ``height`` levels stand on each other: of each stack position the existing one, which holds the siblings
    of the present leaf, and the desired one, its successor, which takes a leaf a step and so is ready when it is needed.
    """
    if not levels:
        yield from ([] for _ in leaves)
        return
    bounds = [(low, min(low + height, levels)) for low in range(0, levels, height)]
    existing = [Growing(leaves, 0, low, high).finish() for low, high in bounds]
    desired = [Growing(leaves, 1, low, high) for low, high in bounds]
    for leaf in range(len(leaves)):
        for k, (low, high) in enumerate(bounds):
            number, inside = divmod(leaf, ARITY**high)
            if leaf and not inside:
                existing[k], desired[k] = desired[k].finish(), Growing(leaves, number + 1, low, high)
            desired[k].step()
        yield [existing[k].siblings(leaf, level) for k, (low, high) in enumerate(bounds) for level in range(low, high)]


def block_root(leaves: list[bytes], levels: int) -> bytes:
    return leaves[0] if not levels else Growing(leaves, 0, levels, levels).finish().root


def pack_path(path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """For each level a byte for each side's number of siblings, then their digests."""
    return b"".join(bytes([len(left), len(right)]) + b"".join(left) + b"".join(right) for left, right in path)


def unpack_path(packed: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    path, at = [], 0
    while at < len(packed):
        left, right = packed[at], packed[at + 1]
        nodes = [packed[k : k + 32] for k in range(at + 2, at + 2 + 32 * (left + right), 32)]
        path.append((nodes[:left], nodes[left:]))
        at += 2 + 32 * (left + right)
    return path


def proof_digest(path: list[tuple[list[bytes], list[bytes]]]) -> str:
    return sha256(b"".join(n.hex().encode() for left, right in path for n in (*left, *right))).hexdigest()


def fold(node: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        node = run_digest([*left, node, *right])
    return node


def field(value: Column) -> Column:
    """A value as its part of a leaf: its length in UTF-8 bytes and itself, ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def _roots(nodes: DataFrame, tree_type: str, levels: int) -> DataFrame:
    """``tree, rank, n, node`` (binary) of the next tier: a node for each block of ``nodes``."""
    width = ARITY**levels

    def root(block: pa.Table) -> pa.Table:
        rows = sorted(zip(block.column("rank").to_pylist(), block.column("node").to_pylist()))
        n = block.column("n")[0].as_py()
        found = block_root([x for _, x in rows], min(levels, levels_above(n)))
        return pa.table({"tree": block.column("tree").slice(0, 1), "rank": [rows[0][0] // width], "n": [-(-n // width)], "node": pa.array([found], pa.binary())})

    blocks = nodes.select("tree", "rank", "n", "node", F.floor(F.col("rank") / width).cast("long").alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(root, f"tree {tree_type}, rank long, n long, node binary")


def tiers(leaves: DataFrame, scratch: Scratch, levels: int) -> list[DataFrame]:
    """The nodes of each tier, from the leaves (``tree, rank, n, node``) up to one node a tree; a block has ``levels``."""
    kind = dict(leaves.dtypes)["tree"]
    found = [leaves]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        found.append(scratch.table(_roots(found[-1], kind, levels)))
    return found


def _with_paths(nodes: DataFrame, above: DataFrame, extra: list[str], emit, schema: str, levels: int) -> DataFrame:
    """What ``emit(columns, rows, path above, paths)`` gives for the blocks of ``nodes``.

    ``above`` (tree, rank, path, root, subroot) has a row for each block: it comes first among the block's rows.
    """
    width = ARITY**levels
    block = F.floor(F.col("rank") / width).cast("long")
    kinds = dict(nodes.dtypes)
    below = nodes.select("tree", block.alias("block"), "rank", "n", "node", *extra, *[F.lit(None).cast("binary").alias(c) for c in ("path", "root", "subroot")])
    heads = above.select("tree", F.col("rank").alias("block"), F.lit(-1).cast("long").alias("rank"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("node"),
                         *[F.lit(None).cast(kinds[c]).alias(c) for c in extra], "path", "root", "subroot")

    def run(block: pa.Table) -> pa.Table:
        rows = block.sort_by("rank").to_pylist()
        head, rows = rows[0], rows[1:]
        paths = traverse([r["node"] for r in rows], min(levels, levels_above(rows[0]["n"])))
        return emit(rows, head, paths, block.column("tree").slice(0, 1))

    return below.unionByName(heads).groupBy("tree", "block").applyInArrow(run, schema)


def _descend(found: list[DataFrame], top: DataFrame, scratch: Scratch, levels: int) -> DataFrame:
    """The paths of tier 1's nodes (the blocks of the leaves), from those of the trees' roots (``top``)."""
    above = top
    for nodes in reversed(found[1:-1]):
        kind = dict(nodes.dtypes)["tree"]

        def emit(rows, head, paths, tree):
            up = head["path"]
            whole = [pack_path(p) + up for p in paths]
            same = lambda c: pa.array([head[c]] * len(rows), pa.binary())
            return pa.table({"tree": pa.concat_arrays(tree.chunks).take(pa.array([0] * len(rows))), "rank": [r["rank"] for r in rows], "path": pa.array(whole, pa.binary()), "root": same("root"), "subroot": same("subroot")})

        above = scratch.table(_with_paths(nodes, above, [], emit, f"tree {kind}, rank long, path binary, root binary, subroot binary", levels))
    return above


def manifest(rows: DataFrame, tree: str, order: list[str], leaf: Column, kept: list[str], probe: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``kept`` columns of every row with ``leaf, subroot, root, proof_sha256, folded_root, verified``, digests in hexadecimal.

    Within a tree (null is one) leaves stand by ``order``, nulls first, then by digest; equal rows have a leaf each. Trees
    stand by the bytes of their names, null first. ``probe`` is the leaf to be checked against the manifest
    (default: the leaf itself); it is folded with the original siblings. A table without rows has no root and gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "merkle")
    names = [f"k{i}" for i in range(len(kept))]
    thin = rows.select(F.col(f"`{tree}`").alias("tree"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)],
                       leaf.alias("node"), (leaf if probe is None else probe).alias("probe"))
    thin = thin.withColumn("probe", F.when(F.col("probe") != F.col("node"), F.col("probe")))  # mostly equal: then it isn't shipped
    ordered = [f"o{i}" for i in range(len(order))]
    leaves = ranked(thin, ["tree"], [*ordered, "node"], scratch).select("tree", "rank", "n", "node", "probe", *names)
    leaves = scratch.table(leaves)
    below = tiers(leaves, scratch, levels)
    # One tree of the trees' roots; trees are told by name, their names stand in order.
    roots = below[-1].select(F.col("tree").alias("name"), F.col("node"))
    over = ranked(roots.withColumn("tree", F.lit(0)), ["tree"], ["name"], scratch)
    over = scratch.table(over.select("tree", "rank", "n", "node", "name"))
    upper = tiers(over.select("tree", "rank", "n", "node"), scratch, levels)
    root = upper[-1].select("tree", F.col("rank"), F.lit(b"").alias("path"), F.col("node").alias("root"), F.lit(None).cast("binary").alias("subroot"))
    paths = _descend([over, *upper[1:]], root, scratch, levels)
    name_type = dict(leaves.dtypes)["tree"]

    def of_source(rows, head, paths, _):
        return pa.table({"name": pa.array([r["name"] for r in rows], pa_type), "path": pa.array([pack_path(p) + head["path"] for p in paths], pa.binary()),
                         "root": pa.array([head["root"]] * len(rows), pa.binary()), "subroot": pa.array([r["node"] for r in rows], pa.binary())})

    pa_type = _arrow_type(leaves, "tree")
    sources = _with_paths(over, paths, ["name"], of_source, f"name {name_type}, path binary, root binary, subroot binary", levels)
    top = scratch.table(sources.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", "root", "subroot"))
    kinds = dict(leaves.dtypes)
    kept_types = {n: _arrow_type(leaves, n) for n in names}

    def of_row(rows, head, paths, _):
        up = unpack_path(head["path"])
        out = {n: pa.array([r[n] for r in rows], kept_types[n]) for n in names}
        proofs, folded = [], []
        for r, path in zip(rows, paths):
            whole = [*path, *up]
            proofs.append(proof_digest(whole))
            folded.append(fold(r["probe"] or r["node"], whole).hex())
        known = head["root"].hex()
        return pa.table(out | {"leaf": [r["node"].hex() for r in rows], "subroot": [head["subroot"].hex()] * len(rows), "root": [known] * len(rows), "proof_sha256": proofs,
                               "folded_root": folded, "verified": [f == known for f in folded]})

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = _with_paths(leaves, _descend(below, top, scratch, levels), ["probe", *names], of_row, schema, levels)
    return found.withColumnsRenamed(dict(zip(names, kept)))


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def query(spark, sf_dir: str) -> DataFrame:
    """Rows of ``documents`` with an even checksum of their id are checked with the line ends of their text gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    digest = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, "source", ["doc_id"], digest(F.col("text")), ["doc_id"], digest(text))


#: Checksums bit by bit, and trees level by level: a row for each node, then for each leaf its way up.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 2 = 0 AS tampered FROM documents
), f AS (
  SELECT doc_id, source, tampered, replace(text, chr(10), '') AS less, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(less) || ':' || less, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS probe FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), up AS (
  SELECT source, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM p
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY source, level, pos // 3
), subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3
), runs AS (
  SELECT source, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL
), low AS (
  SELECT p.doc_id, p.source, p.leaf, p.pos AS nth, 0 AS level, p.pos, probe AS h, '' AS proof FROM p
  UNION ALL
  SELECT low.doc_id, low.source, leaf, nth, low.level + 1, run, sha256(array_to_string(hs[:pos % 3] || [h] || hs[pos % 3 + 2:], '')),
    proof || array_to_string(hs[:pos % 3] || hs[pos % 3 + 2:], '')
  FROM low JOIN runs ON low.source IS NOT DISTINCT FROM runs.source AND low.level = runs.level AND low.pos // 3 = run
), low_top AS (
  SELECT low.doc_id, low.source, leaf, nth, low.h, proof, s.h AS subroot, s.pos FROM low JOIN subroots s ON low.source IS NOT DISTINCT FROM s.source
    JOIN (SELECT source, max(level) AS level FROM up GROUP BY source) m ON m.source IS NOT DISTINCT FROM low.source AND low.level = m.level
), high AS (
  SELECT doc_id, source, leaf, nth, subroot, 0 AS level, pos, h, proof FROM low_top
  UNION ALL
  SELECT doc_id, source, leaf, nth, subroot, high.level + 1, run, sha256(array_to_string(hs[:pos % 3] || [h] || hs[pos % 3 + 2:], '')),
    proof || array_to_string(hs[:pos % 3] || hs[pos % 3 + 2:], '')
  FROM high JOIN top_runs ON high.level = top_runs.level AND high.pos // 3 = run
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, high.h AS folded_root, high.h = root AS verified
FROM high, (SELECT h AS root, level FROM top WHERE n = 1) WHERE high.level = (SELECT max(level) FROM top)
"""
