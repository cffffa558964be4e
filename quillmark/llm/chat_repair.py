"""Conversation structure repair: the cheapest edits that give a conversation its role order.

A conversation's rows become a signature, one letter for a row's role and fault. The distinct signatures of all
conversations are sorted from their ends, so that reading them one after the other walks a prefix trie depth first: a
layer of the dynamic program, the least costs from each state of the role order to the end, is computed once for
each node of the trie and kept on a stack while the walk is below it. At a terminal node the least edits are read off the
stack. The answers are joined back to the conversations, and their rows are edited as they stream by.
"""

from __future__ import annotations

from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, Scratch, frugal

#: Costs of the edits Rerole, Delete and Insert, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the role order (s?(ua)+)?: nothing yet, after the system's row, after a user's, after an assistant's.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, where each role leads.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: From each state, the role a rerole or an insert takes, and where it leads.
EXPECTED = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: The letter of a row that must go; the others are the role's initial (o: any other), in capitals if truncated.
GONE = "d"
_NEVER = 1 << 60
#: Answers up to this size are sent to all executors; more are joined by signature.
BROADCAST_BYTES = 4 << 20


def _inserts(costs: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """A layer with inserts before its row: never more than two, since a third would come back to a state."""
    for state in (USER, ASSISTANT, BEGIN, SYSTEM):
        after = costs[EXPECTED[state][1]][0] + INSERT
        costs[state] = min(costs[state], (after, "I"))
    return costs


def last_layer() -> list[tuple[int, str]]:
    """After all rows: the least cost from each state, and the first edit's letter (none)."""
    return _inserts([(0, ""), (_NEVER, ""), (_NEVER, ""), (0, "")])


def layer(after: list[tuple[int, str]], letter: str) -> list[tuple[int, str]]:
    """The least cost from each state before a row, given the layer after it, and the first edit; ties by its letter."""
    costs = []
    for state in range(4):
        choices = [(after[state][0] + DELETE, "D")]
        if letter != GONE:
            more = TRUNCATED if letter.isupper() else 0
            choices.append((after[EXPECTED[state][1]][0] + REROLE + more, "R"))
            to = NEXT[state].get(letter.lower())
            if to is not None:
                choices.append((after[to][0] + more, "K"))
        costs.append(min(choices))
    return _inserts(costs)


def read_off(stack: list[list[tuple[int, str]]], signature: str) -> tuple[int, str]:
    """Cost and edits of a signature whose layers are ``stack`` (the last row's above the one after all rows)."""
    state, at, edits = BEGIN, len(signature), []
    while True:
        edit = stack[at][state][1]
        if not edit:
            return stack[-1][BEGIN][0], "".join(edits)
        edits.append(edit)
        if edit in "IR":
            state = EXPECTED[state][1]
        elif edit == "K":
            state = NEXT[state][signature[len(signature) - at].lower()]
        at -= edit != "I"


class Trie:
    """The trie of signatures read from their ends, walked depth first: it keeps the layers from the root to the present node.

    Signatures that come sorted by their ends share all layers they can.
    """

    def __init__(self):
        self.stack, self.path, self.layers = [last_layer()], "", 0

    def solve(self, signature: str) -> tuple[int, str]:
        backwards = signature[::-1]
        shared = len(commonprefix((self.path, backwards)))
        del self.stack[shared + 1 :]
        for letter in backwards[shared:]:
            self.stack.append(layer(self.stack[-1], letter))
        self.path = backwards
        self.layers += len(backwards) - shared
        return read_off(self.stack, signature)


def damage(rows: DataFrame) -> DataFrame:
    """The rows of the exercise (``conv_id, turn, role, text, copy``): damaged by a checksum of conversation and turn, nulls as one blank."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` (in their conversation), ``letter`` (their part of the signature) and ``fault`` (blank, duplicate, truncated or null)."""
    by_turn = F.col("turn").asc_nulls_first()
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(by_turn, "copy")) > 1
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(by_turn, "role", "text", "copy"))
    last = F.regexp_extract("text", rf"(?s)({WORD_CLASS}){SPACE_CLASS}*+\z", 1)
    fault = F.when(last == "", "blank").when(earlier, "duplicate").when(~F.regexp_like(last, F.lit("[.!?]")), "truncated")
    role = F.when(initial(F.col("role")).isin("s", "u", "a"), initial(F.col("role"))).otherwise("o")
    rows = rows.withColumns({"fault": fault, "place": place})
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return rows.withColumn("letter", letter)


def summaries(rows: DataFrame, conv_type: pa.DataType) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, signature``: one row for each conversation that has rows.

    Rows stream by, sorted; of a conversation only counts and its signature are kept.
    """
    legal = {"su", "ua", "au"}

    def run(batches):
        now, got = None, None
        for batch in batches:
            out = []
            for conv, turn, first, fault, letter in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "first", "fault", "letter"))):
                if got is None or conv != now:
                    if got:
                        out.append((now, got))
                    now, got = conv, {"min": None, "max": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "letters": []}
                if turn is not None and turn != got["max"]:
                    got["turns"] += 1
                    got["max"] = turn
                    got["min"] = turn if got["min"] is None else got["min"]
                if fault:
                    got[fault] += 1
                if got["last"] is not None and got["last"] + first not in legal:
                    got["illegal"] += 1
                got["last"] = first
                got["letters"].append(letter)
            if out:
                yield table(out)
        if got:
            yield table([(now, got)])

    def table(found):
        gaps = [0 if g["min"] is None else g["max"] - g["min"] + 1 - g["turns"] for _, g in found]
        columns = {"conv_id": pa.array([c for c, _ in found], conv_type), "gaps": gaps} | {k: [g[k] for _, g in found] for k in ("blank", "duplicate", "truncated", "illegal")}
        return pa.RecordBatch.from_pydict(columns | {"signature": ["".join(g["letters"]) for _, g in found]})

    thin = rows.select("conv_id", "place", F.col("turn").cast("long").alias("turn"), initial(F.col("role")).alias("first"), "fault", "letter")
    laid = thin.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return laid.mapInArrow(frugal(run), f"conv_id {dict(rows.dtypes)['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


def answers(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of every distinct signature, by the walk over the trie; ranges of it are walked apart."""
    ends = F.reverse("signature")
    spread = signatures.select("signature").distinct().repartitionByRange(ends).sortWithinPartitions(ends)

    def run(batches):
        trie = Trie()  # goes on from batch to batch
        for batch in batches:
            found = [trie.solve(s) for s in batch.column(0).to_pylist()]
            costs, audits = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "cost", "audit"])

    return spread.mapInArrow(frugal(run), "signature string, cost long, audit string")


def repaired(rows: DataFrame, audits: DataFrame, conv_type: pa.DataType) -> DataFrame:
    """``conv_id, repaired_sha256``: of the lines ``role:text`` after the edits, joined by line ends.

    The audit comes before its conversation's rows; the digest is taken as they stream by.
    """
    def run(batches):
        now, state = None, None  # the digest, whether it has a line, the audit, the place in it, the state of the role order
        started = False
        for batch in batches:
            out = []
            for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
                if not started or audit is not None:
                    if started:
                        out.append((now, state.close()))
                    now, state, started = conv, Repair(audit), True
                else:
                    state.row(role, text)
            if out:
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([c for c, _ in out], conv_type), "repaired_sha256": [h for _, h in out]})
        if started:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([now], conv_type), "repaired_sha256": [state.close()]})

    kinds = dict(rows.dtypes)
    heads = audits.select("conv_id", F.lit(0).alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], "audit")
    both = rows.select("conv_id", "place", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(heads)
    laid = both.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return laid.select("conv_id", "audit", "role", "text").mapInArrow(frugal(run), f"conv_id {kinds['conv_id']}, repaired_sha256 string")


class Repair:
    """The digest of a repaired conversation, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, BEGIN
        self.digest, self.lines = sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = EXPECTED[self.state]
            self._line(role, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            role, self.state = EXPECTED[self.state]
        elif edit == "K":
            self.state = NEXT[self.state][role[:1]]
        if edit != "D":
            self._line(role, text)

    def close(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows``: conv_id, turn, role, text and copy (tells equal rows apart). Null roles and texts must be replaced before;
    a null conversation is one, null turns come first and count for no gap. Rows of one turn stand by role and text,
    copies next to each other. ``conversations``: those to be returned even where no row is left (zeros, no edits, the digest of nothing).
    Roles are told by their initials; one of no known initial can't stay as it is. A text of any length is read
    whole; of a conversation of any length one task holds counts, a letter a row and the digest's state at a time.
    Columns of other names aren't read. Without rows or conversations there is no result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    scratch = Scratch(rows.sparkSession, "repair")
    conv_type = to_arrow_type(rows.schema["conv_id"].dataType)
    rows = scratch.table(with_faults(rows.select("conv_id", "turn", "role", "text", "copy").repartition("conv_id")))
    found = scratch.table(summaries(rows, conv_type))
    solved = scratch.table(answers(found))
    right = solved
    if (solved.agg(F.sum(F.length("signature") * 3)).first()[0] or 0) <= BROADCAST_BYTES:
        right = F.broadcast(solved)
    told = scratch.table(found.join(right, "signature"))
    hashed = repaired(rows, told.select("conv_id", "audit"), conv_type)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = told.select("conv_id", *counts, "audit", F.lit(None).cast("string").alias("repaired_sha256")).unionByName(
        hashed.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"), "repaired_sha256"))
    if conversations is not None:
        nothing = [F.lit(0).cast("long").alias(c) for c in counts]
        parts = parts.unionByName(conversations.select("conv_id").distinct().select("conv_id", *nothing, F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256")))
    # One row of each kind a conversation at most, so this merges up to three thin rows; a missing digest is that of nothing.
    whole = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in counts], F.max("audit").alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))
    return whole.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damage(rows), rows)


#: The same program as SQL: layers from the last row to the first, for all conversations at once, with whole audits for ties.
ORACLE_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), c AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE kind <> 0
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, role[1] AS i FROM d
), g AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i AS pair FROM f
), h AS (
  SELECT *, coalesce(fault, '') IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM g
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM h GROUP BY conv_id
), l AS (
  SELECT conv_id, n AS place, {'c': 0, 'a': ''} AS b, {'c': 6, 'a': 'II'} AS s, {'c': 3, 'a': 'I'} AS u, {'c': 0, 'a': ''} AS a FROM s
  UNION ALL
  SELECT conv_id, place, list_min([b, {'c': u2.c + 3, 'a': 'I' || u2.a}]), list_min([s, {'c': u2.c + 3, 'a': 'I' || u2.a}]), u2, list_min([a, {'c': u2.c + 3, 'a': 'I' || u2.a}])
  FROM (SELECT *, list_min([u, {'c': a.c + 3, 'a': 'I' || a.a}]) AS u2 FROM (
    SELECT l.conv_id, l.place - 1 AS place,
      list_min([{'c': b.c + 4, 'a': 'D' || b.a}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 3 + t, 'a': 'R' || u.a}] END
        || CASE WHEN NOT gone AND i = 'u' THEN [{'c': u.c + t, 'a': 'K' || u.a}] WHEN NOT gone AND i = 's' THEN [{'c': s.c + t, 'a': 'K' || s.a}] ELSE [] END) AS b,
      list_min([{'c': s.c + 4, 'a': 'D' || s.a}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 3 + t, 'a': 'R' || u.a}] END
        || CASE WHEN NOT gone AND i = 'u' THEN [{'c': u.c + t, 'a': 'K' || u.a}] ELSE [] END) AS s,
      list_min([{'c': u.c + 4, 'a': 'D' || u.a}] || CASE WHEN gone THEN [] ELSE [{'c': a.c + 3 + t, 'a': 'R' || a.a}] END
        || CASE WHEN NOT gone AND i = 'a' THEN [{'c': a.c + t, 'a': 'K' || a.a}] ELSE [] END) AS u,
      list_min([{'c': a.c + 4, 'a': 'D' || a.a}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 3 + t, 'a': 'R' || u.a}] END
        || CASE WHEN NOT gone AND i = 'u' THEN [{'c': u.c + t, 'a': 'K' || u.a}] ELSE [] END) AS a
    FROM l JOIN h ON l.conv_id IS NOT DISTINCT FROM h.conv_id AND l.place = h.place))
), r AS (
  SELECT conv_id, b.c AS cost, b.a AS audit FROM l WHERE place = 0
), e AS (
  SELECT conv_id, unnest(generate_series(1, length(audit))) AS nth, audit FROM r
), o AS (
  SELECT conv_id, nth, audit[nth] AS edit, nth - (length(audit[:nth]) - length(replace(audit[:nth], 'I', ''))) AS place FROM e
), q AS (
  SELECT o.*, h.role, h.text, row_number() OVER (PARTITION BY o.conv_id ORDER BY nth) - 1 AS line, first_value(edit = 'K' AND h.i = 's') OVER (PARTITION BY o.conv_id ORDER BY nth) AS sys
  FROM o LEFT JOIN h ON o.conv_id IS NOT DISTINCT FROM h.conv_id AND o.place = h.place WHERE edit <> 'D'
), w AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (line - sys::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
    chr(10) ORDER BY nth)) AS digest FROM q GROUP BY conv_id
)
SELECT DISTINCT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM k LEFT JOIN s ON k.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN r ON k.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN w ON k.conv_id IS NOT DISTINCT FROM w.conv_id
"""
