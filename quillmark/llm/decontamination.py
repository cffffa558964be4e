"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to k errors (a share of its length). Cut into k + 1 pieces, at least one
piece must then occur unchanged. One Aho-Corasick automaton finds all pieces of all items in a text;
around the hits, Myers' bit-parallel algorithm gives the least edit distance of the whole item to any
part of the text. Texts and items are compared in lower case with white space as one blank. Short items are
found without errors only, where no word goes on at either end.

Any k + 1 pieces that don't overlap will do. Where the pieces of an even cut are shared by many items (a template
with its blanks filled in), an item takes its rarest ones instead, so that a text with the template does not make
every item a candidate; items that still meet at one place of a text are compared with it together.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Errors allowed, as a share of an item's characters.
MAX_ERROR = 0.06
#: Items below this length say too little to be found with errors: they are found unchanged, as whole words.
MIN_CHARS = 32
#: Characters of a gram by which the rarity of pieces is judged; no rare piece is shorter.
GRAM = 6
#: An item with an even piece that more items than this may share chooses its pieces by rarity (results don't depend on it).
SHARED = 8
#: Items longer than this are cut evenly: their choice would take longer than it saves.
CHOICE_CHARS = 4096
#: From this number on, the items that start at one place of a text are compared with it together.
TOGETHER = 32
#: Characters of items that one automaton holds (about 60 bytes each); more items take further passes over the texts.
PASS_CHARS = 1_000_000
_MATCH = "item_id long, distance int, item_chars int, start long, stop long"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends.

    ``anchored``: to any part that begins where the text begins.
    """
    m = len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | (1 << i)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, end = score, j + 1
        ph = (ph << 1 | anchored) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    return best, end


def myers_together(patterns: list[str], text: str) -> np.ndarray:
    """The least edit distance of each pattern to any part of ``text``: Myers' columns of all patterns in arrays of words."""
    sizes = np.array([len(p) for p in patterns])
    words = -(-int(sizes.max()) // 64)
    codes = np.full((len(patterns), words * 64), 0x110000, np.uint32)
    for row, p in zip(codes, patterns):
        row[: len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = {c: np.ascontiguousarray(np.packbits(codes == ord(c), axis=1, bitorder="little").view("<u8").T) for c in set(text)}
    one, top = np.uint64(1), np.uint64(63)
    last, bit = (sizes - 1) // 64, ((sizes - 1) % 64).astype(np.uint64)
    ends = [np.flatnonzero(last == w) for w in range(words)]
    up, down = np.full((words, len(patterns)), ~np.uint64(0)), np.zeros((words, len(patterns)), np.uint64)
    score, best = sizes.copy(), sizes.copy()
    for c in text:
        carry = rise = fall = np.zeros(len(patterns), np.uint64)
        for w, eq in enumerate(at[c]):
            u, d = up[w], down[w]
            both = eq & u
            part = both + u
            total = part + carry
            carry = ((part < both) | (total < part)).astype(np.uint64)
            xh, xv = (total ^ u) | eq, eq | d
            ph, mh = d | ~(xh | u), u & xh
            e = ends[w]
            if e.size:
                score[e] += ((ph[e] >> bit[e]) & one).astype(np.int64) - ((mh[e] >> bit[e]) & one).astype(np.int64)
            ph, mh, rise, fall = ph << one | rise, mh << one | fall, ph >> top, mh >> top
            up[w], down[w] = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


def gram_counts(texts: list[str]) -> list[np.ndarray]:
    """For each gram of each text, how often it occurs in all of them (grams of equal hash counted as one)."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in texts]
    hashes = []
    for c in codes:
        h = np.zeros(max(len(c) - GRAM + 1, 0), np.uint64)
        for j in range(GRAM if len(h) else 0):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + len(h)]
        hashes.append(h)
    if not hashes:
        return []
    _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    return np.split(counts[inverse], np.cumsum([len(h) for h in hashes])[:-1])


def cut(size: int, k: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """Where ``k + 1`` pieces of an item lie: cut evenly, or the rarest ones where an even piece may be shared by many items.

    A piece is at most as frequent as its rarest gram. Of pieces of whole, two thirds and half the even length the
    longest are taken whose frequencies sum up to no more than twice the least sum.
    """
    bounds = [size * p // (k + 1) for p in range(k + 2)]
    even = list(zip(bounds, bounds[1:]))
    if not k or size > CHOICE_CHARS or size // (k + 1) < GRAM or max(int(counts[lo : hi - GRAM + 1].min()) for lo, hi in even) <= SHARED:
        return even
    length, choices = size // (k + 1), []
    for n in sorted({length, max(GRAM, length * 2 // 3), max(GRAM, length // 2)}, reverse=True):
        rarest = np.lib.stride_tricks.sliding_window_view(counts, n - GRAM + 1).min(axis=1)
        least = [np.zeros(size + 1)]  # least[j][i]: least sum of j pieces among the first i characters
        for _ in range(k + 1):
            row = np.full(size + 1, np.inf)
            row[n:] = least[-1][: size + 1 - n] + rarest
            least.append(np.minimum.accumulate(row))
        at, pieces = size, []
        for row in reversed(least[1:]):
            at = int(np.searchsorted(-row[: at + 1], -row[at])) - n  # the first end with this sum
            pieces.append((at, at + n))
        choices.append((float(least[-1][-1]), pieces[::-1]))
    floor = min(total for total, _ in choices)
    return next(pieces for total, pieces in choices if total <= 2 * floor)


class ItemIndex:
    """The pieces of a set of items, and the search for them."""

    def __init__(self, items: list[tuple[int, str]], max_error: float):
        self.items = [(i, t, int(len(t) * max_error) if len(t) >= MIN_CHARS else 0) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, ((_, text, k), counts) in enumerate(zip(self.items, gram_counts([t for _, t in items]))):
            for lo, hi in cut(len(text), k, counts):
                places.setdefault(text[lo:hi], []).append((n, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, raw: str | None, first_only: bool = False) -> list[tuple[int, int, int, int, int]]:
        """Each item that occurs, once: id, least distance, length, where it stands in the normalised text.

        ``first_only``: any one of them, if there is one.
        """
        if self.empty or not raw:
            return []
        text = normalise(raw)
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            first = end + 1 - size
            for n, offset in where:
                starts.setdefault(n, set()).add(first - offset)
        self._prune(text, starts)
        out = []
        for n, found in starts.items():
            if first_only and out:
                break
            item_id, item, k = self.items[n]
            m, best = len(item), None
            if m < MIN_CHARS:
                s = min((s for s in found if self._whole(text, s, s + m)), default=None)
                if s is not None:
                    out.append((item_id, 0, m, s, s + m))
                continue
            lo = hi = None
            for s in [*sorted(found), None]:  # windows that overlap are searched as one
                if hi is not None and (s is None or s - k > hi):
                    distance, end = self._search(item, text[lo:hi])
                    if distance <= k and (best is None or distance < best[0]):
                        best = (distance, lo + end - self._length(item, text[lo : lo + end], distance), lo + end)
                    hi = None
                if s is not None:
                    if hi is None:
                        lo = max(0, s - k)
                    hi = min(len(text), s + m + k)
            if best:
                out.append((item_id, best[0], m, best[1], best[2]))
        return sorted(out)

    def _prune(self, text: str, starts: dict[int, set[int]]) -> None:
        """Take away the starts at which many items are looked for and, by a search for all together, one is not."""
        if len(starts) < TOGETHER:
            return
        at: dict[int, list[int]] = {}
        for n, found in starts.items():
            if len(self.items[n][1]) >= MIN_CHARS:
                for s in found:
                    at.setdefault(s, []).append(n)
        for s, members in at.items():
            if len(members) < TOGETHER:
                continue
            members.sort(key=lambda n: len(self.items[n][1]))
            lo = 0
            while lo < len(members):
                hi = lo + 1
                while hi < len(members) and (hi + 1 - lo) * len(self.items[members[hi]][1]) <= PASS_CHARS:
                    hi += 1
                group = [self.items[n] for n in members[lo:hi]]
                k, size = group[-1][2], len(group[-1][1])
                least = myers_together([item for _, item, _ in group], text[max(0, s - k) : s + size + k])
                for n, (_, _, budget), distance in zip(members[lo:hi], group, least):
                    if distance > budget:
                        starts[n].discard(s)
                lo = hi

    @staticmethod
    def _whole(text: str, start: int, stop: int) -> bool:
        """Whether no word goes on over either end of this part of the text."""
        def inner(at: int) -> bool:
            return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()

        return not inner(start) and not inner(stop)

    @staticmethod
    def _length(item: str, window: str, distance: int) -> int:
        """The length of the part at the window's end that is at this distance (of several the shortest)."""
        return myers(item[::-1], window[::-1], anchored=True)[1] if distance else len(item)

    @staticmethod
    def _search(item: str, window: str) -> tuple[int, int]:
        at = window.find(item)
        return (0, at + len(item)) if at >= 0 else myers(item, window)


_KEPT: dict = {}  # of a Python worker: its last automaton, by pass


def _finder(shared, max_error: float) -> ItemIndex:
    """The automaton of a pass; a worker builds it once and keeps one."""
    name, items = shared.value
    if (name, max_error) not in _KEPT:
        _KEPT.clear()
        _KEPT[name, max_error] = ItemIndex(items, max_error)
    return _KEPT[name, max_error]


def _passes(benchmark: DataFrame, item_id: str, text: str) -> list:
    """The items, normalised, as broadcasts of about PASS_CHARS characters (a longer item adds its own length).

    Null and empty items are left out. Items go to passes by a hash, as many as their characters need; a pass has
    to fit into the driver.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t is not null")
    sizes = items.select("i", F.xxhash64("t").alias("h"), F.length("t").cast("long").alias("n")).distinct()
    passes = -(-(sizes.agg(F.sum("n")).first()[0] or 0) // PASS_CHARS)
    spark = benchmark.sparkSession
    for k in range(passes):
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k) if passes > 1 else items
        rows = sorted({(r["i"], normalise(r["t"])) for r in mine.distinct().collect()}, key=lambda r: (r[0] is None, r[0], r[1]))
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, [r for r in rows if r[1]]))


def find_items(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per document and item that occurs in it: ``doc_id`` and where and how closely it does.

    Null and empty texts and items hold nothing; texts and items of any length are searched whole; items below
    MIN_CHARS are found unchanged only; equal items under several ids are all reported, and so are repeated rows.
    Of several places the closest is given, then the first. Positions count characters of the normalised text.
    Without items, texts or matches the result has no rows. Other columns of either table, of any name, are not read.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).limit(0).selectExpr("doc_id", *(f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in _MATCH.split(", ")))
    for k, index in enumerate(_passes(benchmark, item_id, "text")):

        def run(batches, index=index):
            finder = _finder(index, max_error)
            for batch in batches:
                rows = {k: [] for k in ("doc_id", "item_id", "distance", "item_chars", "start", "stop")}
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    for match in finder.find(raw.as_py()):
                        for name, value in zip(rows, (doc_id, *match)):
                            rows[name].append(value)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), "doc_id long, " + _MATCH)
        out = part if not k else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR, text: str = "text") -> DataFrame:
    """``docs``, under all its columns, without the rows in whose text an item occurs; null and empty texts stay."""
    for index in _passes(benchmark, "item_id", "text"):

        def run(batches, index=index):
            finder = _finder(index, max_error)
            for batch in batches:
                clean = np.array([not finder.find(raw.as_py(), first_only=True) for raw in batch.column(text)], bool)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(frugal(run), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
