"""``spark.read.format("markdown")``: files packed into partitions by bytes, filters on path, size and time before any file is opened, and streams."""

from __future__ import annotations

import fnmatch
import heapq
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

SCHEMA = "path string, modified timestamp, size long, text string"
#: Bytes of text in one Arrow batch (a longer file is a batch of its own).
BATCH_BYTES = 16 << 20
_ORDER = {D.GreaterThan: "__gt__", D.GreaterThanOrEqual: "__ge__", D.LessThan: "__lt__", D.LessThanOrEqual: "__le__"}
_TEXT = {D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: str.__contains__}


@dataclass(frozen=True)
class File:
    path: str
    modified: int  # microseconds
    size: int

    def value(self, column: str):
        return datetime.fromtimestamp(self.modified // 10**6, timezone.utc).replace(microsecond=self.modified % 10**6) if column == "modified" else getattr(self, column)


@dataclass
class Files(D.InputPartition):
    files: list[File]


def _test(filter: D.Filter):
    """A filter as a function of a file; None where Spark has to apply it."""
    if isinstance(filter, D.Not):
        inner = _test(filter.child)
        return inner and (lambda f: not inner(f))
    column = getattr(filter, "attribute", ())
    if len(column) != 1 or column[0] not in ("path", "modified", "size"):
        return None
    name, kind = column[0], type(filter)
    if kind is D.IsNotNull:
        return lambda f: True
    if kind is D.IsNull:
        return lambda f: False
    if kind is D.In:
        return None if None in filter.value else lambda f: f.value(name) in filter.value
    if kind in (D.EqualTo, D.EqualNullSafe):
        return None if filter.value is None else lambda f: f.value(name) == filter.value
    if kind in _ORDER and name != "path":  # Spark compares strings by bytes
        return lambda f: getattr(f.value(name), _ORDER[kind])(filter.value)
    if kind in _TEXT and name == "path":
        return lambda f: _TEXT[kind](f.path, filter.value)
    return None


def pack(files: Iterable[File], max_bytes: int, open_cost: int) -> list[Files]:
    """Files in partitions of at most ``max_bytes`` (a longer file alone), each file with the cost of opening it; the longest first, each to the emptiest partition."""
    files = sorted(files, key=lambda f: (-f.size, f.path))
    total = sum(f.size + open_cost for f in files)
    room = [(0, n) for n in range(-(-total // max_bytes))]
    groups: list[list[File]] = [[] for _ in room]
    for f in files:
        used, n = room[0]
        if used and used + f.size + open_cost > max_bytes:
            heapq.heappush(room, (f.size + open_cost, len(groups)))
            groups.append([f])
        else:
            heapq.heapreplace(room, (used + f.size + open_cost, n))
            groups[n].append(f)
    return [Files(g) for g in groups if g]


class _Listing:
    """Options of a source, its files and how they are read."""

    def __init__(self, options, schema: StructType):
        paths = options.get("path")
        if not paths:
            raise ValueError("the markdown source needs a path")
        self.path, self.columns = paths, schema.fieldNames()
        if unknown := set(self.columns) - {"path", "modified", "size", "text"}:
            raise ValueError(f"the markdown source has no columns {sorted(unknown)}")
        self.globs = [options["pathGlobFilter"]] if "pathGlobFilter" in options else ["*.md", "*.markdown"]
        self.max_bytes = int(options.get("maxPartitionBytes", 128 << 20))
        self.open_cost = int(options.get("openCostInBytes", 4 << 20))

    def system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def files(self) -> list[File]:
        system, root = self.system()
        if (info := system.get_file_info(root)).type == fs.FileType.File:
            found = [info]
        else:
            found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and any(fnmatch.fnmatchcase(f.base_name, g) for g in self.globs)]
            found = [f for f in found if not any(part[:1] in "._" for part in f.path[len(root) :].strip("/").split("/"))]
        return [File(f.path, (f.mtime_ns or 0) // 1000, f.size) for f in found]

    def batches(self, part: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self.system()
        types = {"path": pa.string(), "modified": pa.timestamp("us", "UTC"), "size": pa.int64(), "text": pa.string()}
        schema = pa.schema([(c, types[c]) for c in self.columns])
        rows: list[dict] = []
        held = 0
        for f in part.files:
            row = {"path": f.path, "modified": f.modified, "size": f.size}
            if "text" in self.columns:
                with system.open_input_stream(f.path) as stream:
                    row["text"] = stream.read().decode("utf-8", "replace")
                held += f.size
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


class _Reader(D.DataSourceReader):
    def __init__(self, listing: _Listing):
        self.listing, self.tests = listing, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if test := _test(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[D.InputPartition]:
        files = [f for f in self.listing.files() if all(test(f) for test in self.tests)]
        return pack(files, self.listing.max_bytes, self.listing.open_cost) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.listing.batches(partition)


class _StreamReader(D.DataSourceStreamReader):
    """Offsets are the time and path of the last file taken, in the order of both."""

    def __init__(self, listing: _Listing, settle: float):
        self.listing, self.settle = listing, settle

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = (time.time() - self.settle) * 10**6
        last = max(((f.modified, f.path) for f in self.listing.files() if f.modified <= until), default=(-1, ""))
        return {"modified": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        lo, hi = (start["modified"], start["path"]), (end["modified"], end["path"])
        files = [f for f in self.listing.files() if lo < (f.modified, f.path) <= hi]
        return pack(files, self.listing.max_bytes, self.listing.open_cost)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.listing.batches(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class MarkdownDataSource(D.DataSource):
    """Markdown files as rows: ``path`` (as Arrow names it), ``modified, size, text`` (bytes that are no UTF-8 become U+FFFD; an empty file has an empty text).

    Options: ``path`` (a file or a folder with all below it but hidden ones; local or of any file system that Arrow knows),
    ``pathGlobFilter`` (of names; else ``*.md`` and ``*.markdown``), ``maxPartitionBytes`` (128 MB), ``openCostInBytes`` (4 MB), and for streams
    ``settleSeconds`` (0). With a ``schema`` without ``text`` no file is opened. Filters on path (equality, prefix, suffix, part), size
    and modified choose files on the driver (``spark.sql.python.filterPushdown.enabled``).

    A stream takes files in the order of modification time and path. A file that appears with a time before
    one already taken is not seen: give ``settleSeconds`` the longest delay between a file's time and its appearance. A file
    that is changed counts as new, and a file may not be deleted before the batch that it belongs to is done.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return _Reader(_Listing(self.options, schema))

    def streamReader(self, schema: StructType) -> D.DataSourceStreamReader:
        return _StreamReader(_Listing(self.options, schema), float(self.options.get("settleSeconds", 0)))


def register_source(spark: SparkSession) -> None:
    """Makes ``spark.read.format("markdown")`` and ``spark.readStream.format("markdown")`` known, with filters pushed to files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MarkdownDataSource)
