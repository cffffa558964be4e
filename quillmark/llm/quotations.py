"""Chat formatting by quotation linking.

Each message is parsed into its own text and its quoted passages with their nesting levels. Digests
of normalised passages (a block, its paragraphs, lines and sentences) are joined to the first message of the
same conversation that says them; the closest level decides which message is replied to. Threads follow
from these links, and messages are numbered so that each stands after the one it replies to.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, frugal

_QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
#: A sentence of a normalised passage: up to a full stop or the like (and closing marks) before a blank or the end.
_SENTENCE = re.compile(r"\S.*?(?:(?<![.!?…])[.!?…]++[\"'”’»)\]]*+(?=\s|\Z)|[。！？]++[”’」』]*+|\Z)", re.S)
_SAYS = re.compile(r"^(?:on\b.*\bwrote|.{1,80}\b(?:wrote|said|schrieb|a écrit|escribió))\s*:\s*$", re.I)
_PARSED = "uid long, conv_id long, turn long, role string, own string, quotes array<struct<level:int,hash:long,chars:int>>, said array<long>"


def _digest(passage: str) -> int:
    return xxhash.xxh64_intdigest(passage) - (1 << 63)


def _normal(passage: str) -> str:
    return " ".join(passage.lower().split())


def _pieces(block: str) -> set[str]:
    """A passage as a whole, its paragraphs, lines and sentences, normalised; none is too short."""
    parts = {_normal(block), *map(_normal, re.split(r"\n[ \t]*\n", block)), *map(_normal, block.split("\n"))}
    sentences = {s.strip() for p in parts for s in _SENTENCE.findall(p)}
    return {p for p in parts | sentences if p}


def parse_message(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message's own text, and its quoted blocks as (level, text); one level's adjoining lines are a block.

    A line that says who wrote what follows ("On ... wrote:") goes with the quotation it introduces.
    """
    lines = []
    for line in (text or "").split("\n"):
        mark = _QUOTE.match(line)
        lines.append((mark[1].count(">"), line[mark.end() :]) if mark else (0, line))
    own, blocks = [], []
    for k, (level, line) in enumerate(lines):
        if not level:
            if _SAYS.match(line.strip()):
                after = next((x for x in lines[k + 1 :] if x[0] or x[1].strip()), None)
                if after and after[0]:
                    continue
            own.append(line)
        elif blocks and k and lines[k - 1][0] == level:
            blocks[-1][1].append(line)
        else:
            blocks.append((level, [line]))
    kept = re.sub(r"\n(?:[ \t]*\n){2,}", "\n\n", "\n".join(own)).strip() if blocks else "\n".join(own)
    return kept, [(level, "\n".join(x)) for level, x in blocks]


def _parse(batches):
    task = TaskContext.get()
    uid = (task.partitionId() if task else 0) << 36
    for batch in batches:
        own, quotes, said = [], [], []
        for text in batch.column("text").to_pylist():
            kept, blocks = parse_message(text)
            own.append(kept)
            quotes.append([{"level": level, "hash": _digest(p), "chars": len(p)} for level, block in blocks for p in sorted(_pieces(block))])
            said.append([_digest(p) for p in sorted(_pieces(kept))])
        n = len(own)
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("chars", pa.int32())]))
        arrays = [pa.array(range(uid, uid + n), pa.int64()), batch.column("conv_id"), batch.column("turn"), batch.column("role"),
                  pa.array(own, pa.string()), pa.array(quotes, kind), pa.array(said, pa.list_(pa.int64()))]
        uid += n
        yield pa.RecordBatch.from_arrays(arrays, ["uid", "conv_id", "turn", "role", "own", "quotes", "said"])


def _numbered(batches):
    """Rows in order, each with its number among its conversation's rows in this partition."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    last, n = object(), 0
    for batch in batches:
        numbers = []
        for conv in batch.column("conv_id").to_pylist():
            n = n + 1 if conv == last else 0
            last = conv
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int32())], [*batch.schema.names, "nth", "part"])


def _links(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """``uid, parent``: for each message that quotes an earlier one of its conversation, that one."""
    quotes = parsed.where("size(quotes) > 0").select("uid", "conv_id", "turn", F.explode("quotes").alias("q"))
    quotes = scratch.table(quotes.select("uid", "conv_id", "turn", "q.level", "q.hash", "q.chars"))
    bitmap = Bitmap(quotes.select(F.xxhash64("conv_id", "hash").alias("key")), "key")
    said = parsed.select("conv_id", "turn", "uid", F.explode("said").alias("hash")).where(bitmap.may_hold(F.xxhash64("conv_id", "hash")))
    first = said.groupBy("conv_id", "hash").agg(F.min(F.struct("turn", "uid")).alias("first"))
    linked = quotes.join(first, ["conv_id", "hash"]).where("first.turn < turn")
    best = F.min_by(F.struct(F.col("first.uid").alias("uid")), F.struct("level", (-F.col("chars")).alias("c"), (-F.col("first.turn")).alias("t"), F.col("first.uid").alias("u")))
    return scratch.table(linked.groupBy("uid").agg(best.alias("p")).select("uid", F.col("p.uid").alias("parent")))


def _threads(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``uid, parent, root, depth``, by doubling the links until all reach a message that replies to none."""
    state = scratch.table(links.select("uid", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = state.select(F.col("uid").alias("at"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = state.join(up, F.col("root") == F.col("at"), "left")
        joined = joined.select("uid", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        joined = scratch.table(joined)
        state = joined.drop("moved")
        if not joined.where("moved").limit(1).count():
            return state


def link_quotations(messages: DataFrame) -> DataFrame:
    """Messages without their quotations: ``conv_id, position, turn, role, text, reply_to, thread, depth``.

    ``reply_to`` is the turn of the message quoted (null: none found), ``thread`` the turn that its
    thread begins with, ``depth`` the number of links to there, ``position`` counts a conversation's rows
    from 0: threads by their first turn, in each by turn, so a reply stands after what it replies to. Null
    and empty texts stay as empty texts. Rows that repeat a conversation and turn keep a number each;
    null conversations are numbered together and never linked. Other columns of ``messages`` are not
    read. A conversation of any size is numbered in pieces: rows are range-partitioned, numbered in
    their partitions, and the pieces' counts give each piece's first number.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parsed = scratch.table(rows.mapInArrow(frugal(_parse), _PARSED))
    threads = _threads(_links(parsed, scratch), scratch)
    turns = parsed.select("uid", "turn")
    named = (
        threads.join(turns.select(F.col("uid").alias("parent"), F.col("turn").alias("reply_to")), "parent")
        .join(turns.select(F.col("uid").alias("root"), F.col("turn").alias("thread")), "root").select("uid", "reply_to", "thread", "depth")
    )
    joined = parsed.select("uid", "conv_id", "turn", "role", F.col("own").alias("text")).join(named, "uid", "left")
    joined = joined.withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    keys = ["conv_id", "thread", "turn", "uid"]
    ordered = joined.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields)
    numbered = scratch.table(ordered.mapInArrow(frugal(_numbered), fields + ", nth long, part int"))
    pieces = numbered.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).where("first > 0")
    pieces = pieces.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first")
    placed = numbered.join(pieces, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    position = F.col("nth") + F.coalesce("first", F.lit(0))
    return placed.select("conv_id", position.alias("position"), "turn", "role", "text", "reply_to", "thread", F.col("depth").cast("int").alias("depth"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: For tables without quoted lines (a line that begins with ">"), as the oracle's are: every message
#: is its own thread. With quotations the operator is tested against a brute-force version.
ORACLE_SQL = r"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, turn, role, coalesce(text, '') AS text,
  NULL::BIGINT AS reply_to, turn AS thread, 0::INTEGER AS depth FROM conversations
"""
