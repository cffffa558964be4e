"""The latest revision of each document as keyed state, and what its nodes changed."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from datetime import timedelta
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import node_columns
from ..options import Options

#: What makes two nodes of one type the same.
_CONTENT = ("value", "url", "title", "alt", "lang", "meta", "identifier", "reference_type", "depth", "ordered", "start", "checked", "name", "text", "cells")
#: Texts of at most this length are remembered with their signatures, so many of them; about 50 MB in a worker at most.
_SHORT, _REMEMBERED = 1_000, 1 << 12


def _signed(text: str, flags: int) -> str:
    columns = node_columns(text, flags)
    names = [c for c in _CONTENT if c in columns]
    signed = []
    for kind, *values in zip(columns["type"], *(columns[c] for c in names)):
        content = repr([(c, v) for c, v in zip(names, values) if v is not None])
        signed.append(f"{kind} {blake2b(content.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}")
    return ",".join(signed)


@lru_cache(_REMEMBERED)
def _remembered(text: str, flags: int) -> str:
    return _signed(text, flags)


def signatures(text, options: Options = Options()):
    """Type and hash of the content of each node of a document, ``type hash`` joined by commas (null: null).

    One string, signed where the text is parsed: nodes would become columns and each nested value a Python object on its way to the state.
    """

    flags = options.flags

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else (_remembered if len(t) <= _SHORT else _signed)(t, flags) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, T.StringType())(text)


def _counted(nodes: str | None) -> Counter:
    return Counter(nodes.split(",")) if nodes else Counter()


class _Latest(StatefulProcessor):
    """State of a bucket: of each of its documents, by key, the time and hash of its latest revision and its node signatures; one timer.

    Each call to the state takes Python a round trip, so it is made for a bucket. The timer is at the time when the first document
    is due or earlier: a newer revision leaves it, and when it goes off it is set anew for what is left.
    """

    def __init__(self, key: str, expire_ms: int, plain: bool):
        self.key, self.expire_ms, self.plain = key, expire_ms, plain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "timer long, documents binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best: dict = {}
        for r in rows:
            seen = (r["_us"], r["_tie"], r["_nodes"], r["_key"])
            name = self._name(seen[3])
            if name not in best or seen[:2] > best[name][:2]:
                best[name] = seen
        timer, known = self._read()
        newer = {n: seen for n, seen in best.items() if n not in known or seen[:2] > known[n][:2]}
        if not newer:
            return
        due = self._due(min(seen[0] for seen in newer.values()))
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self._write(timer, known | newer)
        for name, (at, _, nodes, doc) in newer.items():
            old = known.get(name)
            fresh, gone = _counted(nodes), _counted(old and old[2])
            yield from self._rows(doc, "revision", at, old and old[0], self._by_type(fresh - gone), self._by_type(gone - fresh))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, known = self._read()
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        kept, gone = {}, []
        for name, seen in known.items():
            due = self._due(seen[0])
            if due < now or due <= fired:
                gone.append(seen)
            else:
                kept[name] = seen
        if kept:
            timer = self._due(min(seen[0] for seen in kept.values()))
            self.handle.registerTimer(timer)
            self._write(timer, kept)
        else:
            self.latest.clear()
        for at, _, nodes, doc in gone:
            yield from self._rows(doc, "expired", at + self.expire_ms * 1000, at, Counter(), self._by_type(_counted(nodes)))

    def _name(self, doc):
        """What a document is looked up by: its key, or for nested values and fractions (not a number equals nothing) how it is written."""
        return doc if self.plain else repr(doc + 0.0 if isinstance(doc, float) else doc)

    def _read(self) -> tuple[int | None, dict]:
        old = self.latest.get()
        return (None, {}) if old is None else (old[0], pickle.loads(bytes(old[1])))

    def _write(self, timer: int, known: dict) -> None:
        self.latest.update((timer, pickle.dumps(known, pickle.HIGHEST_PROTOCOL)))

    @staticmethod
    def _by_type(entries: Counter) -> Counter:
        total: Counter = Counter()
        for entry, n in entries.items():
            total[entry.split(" ")[0]] += n
        return total

    def close(self) -> None:
        pass

    def _due(self, at: int) -> int:
        return at // 1000 + self.expire_ms

    def _rows(self, doc, event, at, before, added, removed) -> Iterator[Row]:
        """One row, if anything changed: each of Python's rows becomes a table of its own on its way out."""
        if kinds := sorted({*added, *removed}):
            yield Row(**{self.key: doc, "event": event, "at": at, "before": before, "_changes": ",".join(f"{k} {added[k]} {removed[k]}" for k in kinds)})


def revision_changes(docs: DataFrame, key: str, time: str, text: str = "text", late: str = "10 minutes", expire: timedelta = timedelta(days=7), options: Options = Options(), buckets: int = 1 << 16) -> DataFrame:
    """For each newer revision of a document: how many nodes of each type it adds to and removes from the latest one so far.

    ``key, event, at, before, type, added, removed``: ``event`` is "revision", or "expired" for a document without
    a newer revision for ``expire`` of event time: its nodes go, and so does its state; ``before`` is the time of the revision compared
    with (null: none). Revisions are ordered by ``time`` (to the microsecond), then by a hash of their text; older ones, and
    repeats, change nothing, whatever the order or the batches in which they come, so the sums of ``added - removed`` are
    the nodes of the latest revisions. A node whose content changes counts as one removed and one added. A null text
    deletes the document's nodes; rows without key or time, and rows more than ``late`` behind the stream, are left out.

    Nodes are signed before the exchange, so texts are not shuffled. Documents are dealt by a hash of their key to ``buckets``; the state of a
    bucket is one value with type and hash of its documents' nodes, read and written once a batch in which one of them comes. So calls to the
    state grow no further than to ``buckets`` a batch, but a changed document writes those of its bucket: take a number of ``buckets`` that leaves
    each some 10 to 100 documents (it can't be changed for a checkpoint that has state). Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kind = docs.schema[key].dataType
    plain = not isinstance(kind, (T.FloatType, T.DoubleType, T.ArrayType, T.StructType))
    signed = docs.withWatermark(time, late).where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).alias("_bucket"), F.col(key).alias("_key"), F.col(time).alias("_time"), F.unix_micros(F.col(time)).alias("_us"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("\0"))).alias("_tie"), signatures(F.col(text), options).alias("_nodes"),
    )
    result = T.StructType([T.StructField(key, kind)]).add("event", "string").add("at", "long").add("before", "long").add("_changes", "string")
    changes = signed.groupBy("_bucket").transformWithState(_Latest(key, int(expire.total_seconds() * 1000), plain), result, "Append", "EventTime")
    told = changes.select(key, "event", "at", "before", F.explode(F.split("_changes", ",")).alias("_one")).withColumn("_one", F.split("_one", " "))
    return told.select(key, "event", F.timestamp_micros("at").alias("at"), F.timestamp_micros("before").alias("before"),
                       F.col("_one")[0].alias("type"), F.col("_one")[1].cast("long").alias("added"), F.col("_one")[2].cast("long").alias("removed"))
