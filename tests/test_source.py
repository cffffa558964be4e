"""The markdown data source: packing, filters before files are opened, streams with offsets."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.sources import register_source
from quillmark.sources.datasource import File, Files, _Listing, pack


@pytest.fixture
def folder(spark, tmp_path):
    register_source(spark)
    root = tmp_path / "docs"
    (root / "a" / "b").mkdir(parents=True)
    (root / "_hidden").mkdir()
    for n in range(40):
        (root / ("a" if n % 2 else "a/b") / f"{n:02}.md").write_text(f"# Title {n}\n" + "x" * n)
    (root / "empty.markdown").write_text("")
    (root / "bad.md").write_bytes(b"\xff")
    (root / "other.txt").write_text("no")
    (root / "_hidden" / "h.md").write_text("no")
    return str(root)


def test_rows_and_packing(spark, folder):
    docs = spark.read.format("markdown").load(folder)
    rows = {os.path.basename(r.path): r for r in docs.collect()}
    assert len(rows) == 42 and rows["07.md"].text == "# Title 7\n" + "x" * 7 and rows["empty.markdown"].text == "" and rows["bad.md"].text == "�"
    assert all(r.size == os.path.getsize(r.path) for r in rows.values())
    assert docs.rdd.getNumPartitions() == 2  # 42 files of 4 MB to open each
    assert spark.read.format("markdown").option("openCostInBytes", 0).load(folder).rdd.getNumPartitions() == 1
    assert spark.read.format("markdown").load("file://" + folder).count() == 42
    assert spark.read.format("markdown").load(folder + "/bad.md").count() == 1
    assert spark.read.format("markdown").option("pathGlobFilter", "0*.md").load(folder).count() == 10
    assert spark.read.format("markdown").load(folder + "/_hidden").where("size < 0").count() == 0


def test_pack_by_bytes():
    sizes = [1000, 500, 400, 300, 5, 5, 0, 90]
    parts = pack([File(str(n), 0, s) for n, s in enumerate(sizes)], 600, 10)
    assert sorted(f.path for p in parts for f in p.files) == [str(n) for n in range(len(sizes))]
    assert all(sum(f.size + 10 for f in p.files) <= 600 or len(p.files) == 1 for p in parts)
    assert pack([], 600, 10) == []


def test_filters_choose_files(spark, folder):
    docs = spark.read.format("markdown").load(folder)
    chosen = docs.where(F.col("path").startswith(folder + "/a/b") & (F.col("size") > 30))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        chosen.explain("formatted")
    plan = out.getvalue()
    assert "BatchScan" in plan and "StringStartsWith(path" in plan and "GreaterThan(size" in plan, plan
    assert {os.path.basename(r.path) for r in chosen.collect()} == {f"{n:02}.md" for n in range(0, 40, 2) if os.path.getsize(f"{folder}/a/b/{n:02}.md") > 30}
    both = docs.where(F.col("text").contains("Title 3") & ~F.col("path").endswith("3.md") & F.col("path").isin(folder + "/a/03.md", folder + "/a/b/30.md"))
    assert [os.path.basename(r.path) for r in both.collect()] == ["30.md"]
    assert docs.where("modified < timestamp'2000-01-01'").count() == 0 and docs.where("modified > timestamp'2000-01-01' and path > ''").count() == 42


def test_no_file_is_opened_for_its_metadata(spark, folder):
    absent = Files([File("/nowhere/x.md", 5, 3)])
    schema = StructType().add("size", "long").add("path", "string")
    assert [b.to_pylist() for b in _Listing({"path": "/nowhere"}, schema).batches(absent)] == [[{"size": 3, "path": "/nowhere/x.md"}]]
    docs = spark.read.format("markdown").schema(schema).load(folder)
    assert docs.columns == ["size", "path"] and docs.where("size = 0").count() == 1


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    def drain():
        stream = spark.readStream.format("markdown").load(folder)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120)
        return [os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    first = drain()
    assert len(first) == len(set(first)) == 42
    with open(folder + "/new.md", "w") as f:
        f.write("new")
    assert sorted(drain()) == sorted(first + ["new.md"])
    assert len(drain()) == 43
