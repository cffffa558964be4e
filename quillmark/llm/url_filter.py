"""URL filters: rules in a sorted digest array.

The 64-bit xxHash keys of all rules are sorted into one array, which executors fetch as a file and
map into memory; the rules' full strings lie beside it. A URL's candidates (each suffix of its host
by labels, with its path cut to each length that some rule's path has) are looked up by vectorised
binary search, and a hit counts only if the stored string equals the candidate.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The verdict on a URL that no rule fits: nothing speaks against it.
DEFAULT = "allow"
_SPLIT = b"\x00"


class RuleIndex:
    """The array's file: number of rules, keys, verdicts, offsets of the strings, the strings."""

    @staticmethod
    def build(rules) -> bytes:
        entries = {}
        for host, path, verdict in rules:
            entries[host.lower().encode() + _SPLIT + path.encode()] = verdict
        strings = sorted(entries, key=lambda s: (xxhash.xxh64_intdigest(s), s))
        keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], "<u8")
        verdicts = np.array([entries[s] == "block" for s in strings], np.uint8)
        ends = np.cumsum([0, *map(len, strings)]).astype("<u8")
        lengths = np.unique([len(s.split(_SPLIT)[1]) for s in strings]).astype("<u8")
        head = np.array([len(strings), len(lengths)], "<u8")
        return b"".join(x.tobytes() for x in (head, keys, ends, lengths, verdicts)) + b"".join(strings)

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in data[:16].view("<u8"))
        at = 16
        self.keys = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = data[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.lengths = [int(x) for x in data[at : at + 8 * m].view("<u8")]
        at += 8 * m
        self.verdicts = data[at : at + n]
        self.strings = data[at + n :]

    def string(self, k: int) -> bytes:
        return self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """For each candidate the number of its rule, or -1."""
        found = np.full(len(candidates), -1)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        for k in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else ():
            j = int(at[k])
            while j < len(self.keys) and self.keys[j] == keys[k]:  # other strings may share the digest
                if self.string(j) == candidates[k]:
                    found[k] = j
                    break
                j += 1
        return found


def split_url(url) -> tuple:
    """Native ``host`` and ``path`` columns of a url column (null or without ``://``: both empty)."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def url_verdicts(urls: DataFrame, rules=RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path; of several the
    longest string wins, then the one with the longer host. The index is built on the driver from
    the rule list, written to the shared folder and mapped from each executor's copy. Null urls have
    an empty host and path and get the default. Repeated rows get the same verdict; urls of any length are read
    whole; a table without rows gives none. Columns of ``urls`` named like the four are replaced, all others stay.
    """
    spark = urls.sparkSession
    name = f"rules-{uuid.uuid4().hex}.bin"
    target = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(target)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    stream.write(bytearray(RuleIndex.build(rules)))
    stream.close()
    spark.sparkContext.addFile(target)
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(url))
    parts = urls.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", rule string, verdict string"

    def run(batches):
        index = RuleIndex(SparkFiles.get(name))
        for batch in batches:
            candidates, owner = [], []
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            for k, (h, p) in enumerate(zip(hosts, paths)):
                labels, path_bytes = h.split(".") if h else [], p.encode()
                for i in range(len(labels)):
                    suffix = ".".join(labels[i:]).encode() + _SPLIT
                    for n in index.lengths:
                        if n <= len(path_bytes):
                            candidates.append(suffix + path_bytes[:n])
                            owner.append(k)
            best: dict[int, tuple] = {}
            found = index.probe(candidates)
            for c in np.flatnonzero(found >= 0):
                rank = (len(candidates[c]), candidates[c].index(_SPLIT), int(found[c]))
                best[owner[c]] = max(best.get(owner[c], rank), rank)
            chosen = [best.get(k) for k in range(len(hosts))]
            rule = [index.string(b[2]).replace(_SPLIT, b"").decode() if b else None for b in chosen]
            verdict = [("block" if index.verdicts[b[2]] else "allow") if b else default for b in chosen]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(frugal(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
