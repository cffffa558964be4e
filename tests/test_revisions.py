"""Latest revisions as keyed state: late, repeated and unordered rows, deletion and expiry."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmark.operators import nodes
from quillmark.streaming import revision_changes
from quillmark.streaming.revisions import _Latest

T0 = datetime(2024, 5, 1, 12)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def run(spark, tmp_path):
    """Feeds batches, one file each, and gives the rows of every batch."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def feed(batches, **choice):
        for n, rows in enumerate(batches):
            rows = [(k, T0 + timedelta(minutes=m), t) for k, m, t in rows]
            spark.createDataFrame(rows, "doc string, ts timestamp, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("doc string, ts timestamp, text string").parquet(str(tmp_path / "in"))
            out = revision_changes(stream, "doc", "ts", **choice)
            query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
            assert query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).collect()

    yield feed
    spark.conf.set(STORE, before)


def _sum(rows):
    total = Counter()
    for r in rows:
        total[r.doc, r.type] += r.added - r.removed
    return {k: n for k, n in total.items() if n}


def test_sums_are_the_latest_revisions(spark, run):
    batches = [
        [("a", 0, "# A\n\none"), ("b", 1, "* x\n* y"), ("a", 2, "# A\n\ntwo")],
        [("a", 1, "late and older"), ("b", 1, "* x\n* y"), ("c", 3, "[l](/u)")],
        [("c", 4, None), ("b", 5, "* x\n* z\n* w"), (None, 5, "no key")],
    ]
    rows = run(batches)
    latest = spark.createDataFrame([("a", "# A\n\ntwo"), ("b", "* x\n* z\n* w")], "doc_id string, text string")
    expected = {(r.doc_id, r.type): r["count"] for r in nodes(latest).groupBy("doc_id", "type").count().collect()}
    assert _sum(rows) == expected
    assert {r.at for r in rows if r.doc == "a"} == {T0 + timedelta(minutes=2)}
    b = {r.type: (r.added, r.removed) for r in rows if r.doc == "b" and r.before is not None}
    assert b["text"] == (2, 1) and b["listItem"] == (1, 0)


def test_documents_expire(run):
    rows = run([[("a", 0, "# A")], [("b", 200, "b")], [("b", 201, "b b")], [("a", 202, "# A")]], late="1 minute", expire=timedelta(hours=1))
    gone = [r for r in rows if r.event == "expired"]
    assert {(r.doc, r.type, r.removed) for r in gone} == {("a", "root", 1), ("a", "heading", 1), ("a", "text", 1)}
    assert {r.at for r in gone} == {T0 + timedelta(hours=1)}
    assert [r.before for r in rows if r.doc == "a" and r.event == "revision" and r.at == T0 + timedelta(minutes=202)] == [None] * 3


class _Calls:
    """A bucket's state and timers, with the calls made to them."""

    def __init__(self):
        self.value, self.timers, self.said = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.said.append("get")
        return self.value

    def update(self, value):
        self.said.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.said.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.fired


@pytest.mark.parametrize(("plain", "keys"), [(True, list(range(50))), (False, [k / 7 for k in range(49)] + [float("nan")])])
def test_documents_of_a_bucket_share_calls_to_the_state(plain, keys):
    """Each call takes a round trip: a batch makes as many for 50 documents as for one; documents expire by themselves all the same."""
    calls, latest = _Calls(), _Latest("doc", 10, plain)
    latest.init(calls)
    rows = lambda us: [{"_key": k, "_us": us + n, "_tie": t, "_nodes": f"root {us},text {t}"} for n, k in enumerate(keys) for t in (1, 2)]
    first = list(latest.handleInputRows((0,), rows(1_000_000), calls))
    assert calls.said == ["get", "timer", "update"] and len(first) == 50 and calls.timers == {1010}
    assert not list(latest.handleInputRows((0,), rows(1_000_000), calls))
    again = list(latest.handleInputRows((0,), rows(5_000_000)[:4], calls))
    assert [(r["before"], r["_changes"]) for r in again] == [(1_000_000, "root 1 1"), (1_000_001, "root 1 1")] and calls.timers == {1010}
    calls.now = calls.fired = 1010
    gone = list(latest.handleExpiredTimer((0,), calls, calls))
    assert len(gone) == 48 and all(r["event"] == "expired" and r["_changes"] == "root 0 1,text 0 1" for r in gone)
    assert calls.timers == {1010, 5010}
    calls.now = calls.fired = 5010
    assert len(list(latest.handleExpiredTimer((0,), calls, calls))) == 2 and calls.value is None
