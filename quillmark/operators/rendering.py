"""Node rows back to HTML and JSON, whatever has been done to them."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import NODE
from ..kernel.fold import HTML_COLUMNS, JSON_COLUMNS, PLACES, HtmlFold, JsonFold
from ..kernel.sinks import escape_text, trim_lines
from .trees import values

#: Rows that are alike but for texts, subtrees of them, and characters in them, that a task remembers: more start anew.
_KEPT, _KEPT_CHARS = 20_000, 10_000_000
_KINDS = {f.name: f.dataType for f in NODE}


def _columns(tree: DataFrame, names) -> list:
    """The tree's columns of these names; what it lacks is null."""
    return [F.col(n) if n in tree.columns else F.lit(None).cast(_KINDS[n]).alias(n) for n in names]


def _laid(tree: DataFrame, key: str) -> DataFrame:
    """Each document's rows in one partition, with ``_nth``, their number in the document, for :func:`_folded`. A window asks for that, so rows that lie so stay
    where they are, and the order that a fold takes them in is the window's."""
    return tree.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("node_id")))


def _folded(rows: DataFrame, key: str, names: tuple[str, ...], fold, result: str) -> DataFrame:
    """``key`` and what ``fold`` makes of a document's rows, which come sorted and leave no more than open frames in a task."""
    kind = dict(rows.dtypes)[key]
    # Lists and maps go as JSON: Spark asks for a batch's size at each row, which for a list that is null takes as long as all rows before.
    nested = {n: rows.schema[n].dataType for n in names if isinstance(rows.schema[n].dataType, (T.ArrayType, T.MapType))}
    pairs = {n for n, t in nested.items() if isinstance(t, T.MapType)}
    shipped = [F.to_json(n, {"ignoreNullFields": "false"}).alias(n) if n in nested else n for n in names]

    def read(name, column):
        found = values(column)
        if name not in nested:
            return found
        hook = list if name in pairs else None
        return [None if v is None else json.loads(v, object_pairs_hook=hook) for v in found]

    def run(batches):
        now, folding, done = None, None, ([], [])

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(done[0], key_type), pa.array(done[1], pa.string())], [key, result])
            done[0].clear()
            done[1].clear()
            return made

        key_type = pa.null()
        for batch in batches:
            key_type = batch.column(key).type
            columns = [read(n, batch.column(n)) for n in names]
            for doc, nth, kind, level, *given in zip(*(values(batch.column(n)) for n in (key, "_nth", "type", "depth_in_tree")), *columns):
                if nth == 1:
                    if folding is not None:
                        done[0].append(now)
                        done[1].append(folding.end())
                    now, folding = doc, fold()
                folding.row(kind, level, dict(zip(names, given)))
            if done[0]:
                yield flush()
        if folding is not None:
            done[0].append(now)
            done[1].append(folding.end())
            yield flush()

    laid = rows.select(key, "_nth", "node_id", "type", "depth_in_tree", *shipped).sortWithinPartitions(key, "node_id")
    return laid.drop("node_id").mapInArrow(run, f"`{key}` {kind}, {result} string")


#: Columns of a row's look that are JSON inside of ``_look``: null values and the order of a map count.
_NESTED = {"align": None, "properties": list}


def _look(tree: DataFrame) -> Column:
    """All columns that a fold reads besides type, level and value, as JSON without those that are null (null: all are).

    Most are null in most rows, and each costs a task as much as those that aren't: in sorts, and as Spark asks for the size of an Arrow batch at each row.
    """
    told = [n for n in HTML_COLUMNS if n != "value" and n in tree.columns]
    if not told:
        return F.lit(None).cast("string")
    fields = [(F.to_json(n, {"ignoreNullFields": "false"}) if n in _NESTED else F.col(n)).alias(n) for n in told]
    return F.when(reduce(or_, [F.col(n).isNotNull() for n in told]), F.to_json(F.struct(*fields)))


def _head(first: Column) -> Column:
    """One column of all that a row is besides its value: whether it is its document's ``first``, its level, type and look. Each column of a batch costs time at each row."""
    return F.concat(F.when(first, "1").otherwise("0"), F.col("depth_in_tree").cast("string"), F.lit(":"), F.coalesce("type", F.lit("")), F.lit("\n"), F.coalesce("_look", F.lit("")))


class _Alike:
    """Numbers for rows by all but their texts: rows of one number look alike."""

    def __init__(self):
        self.heads: dict[str, tuple[bool, str, int, str]] = {}
        self.known: dict[tuple, int] = {}
        self.rows: list[tuple[str, int, dict]] = []
        self.chars = 0

    def __call__(self, heads: pa.Array, value: pa.Array) -> tuple[np.ndarray, ...]:
        """For each row its number, whether it is a document's first one, a text and an item, and its level."""
        found = heads.dictionary_encode()
        at = found.indices.to_numpy(zero_copy_only=False)
        told = [self._told(h) for h in values(found.dictionary)]
        first, is_text, is_item, levels = (np.array(v)[at] for v in ([t[0] for t in told], [t[1] == "text" for t in told], [t[1] == "listItem" for t in told], [t[2] for t in told]))
        named = pc.if_else(pa.array(is_text), pa.scalar(None, value.type), value).dictionary_encode()
        n = len(named.dictionary)
        codes = at.astype(np.int64) * (n + 1) + pc.fill_null(named.indices, n).to_numpy(zero_copy_only=False)
        unique, inverse = np.unique(codes, return_inverse=True)
        others = [*values(named.dictionary), None]
        numbers = [self._number(*told[code // (n + 1)][1:], others[code % (n + 1)]) for code in unique.tolist()]
        return np.array(numbers, np.int32)[inverse], first, is_text, is_item, levels

    def _told(self, head: str) -> tuple[bool, str, int, str]:
        told = self.heads.get(head)
        if told is None:
            place, _, look = head.partition("\n")
            level, _, kind = place[1:].partition(":")
            told = self.heads[head] = (head[0] == "1", kind, int(level), look)
            self.chars += len(head)
        return told

    def _number(self, *row) -> int:
        number = self.known.get(row)
        if number is None:
            number = self.known[row] = len(self.rows)
            kind, level, look, value = row
            attrs = dict.fromkeys(HTML_COLUMNS) | (json.loads(look) if look else {}) | {"value": value}
            for n, hook in _NESTED.items():
                if attrs[n] is not None:
                    attrs[n] = json.loads(attrs[n], object_pairs_hook=hook)
            self.rows.append((kind, level, attrs))
            self.chars += len(value or "")
        return number


def _texts(column: pa.Array, is_text: np.ndarray) -> list[str | None]:
    """The HTML of the texts among the values."""
    found = values(column)
    special = pc.fill_null(pc.match_substring_regex(column, r"[&<\r\n]"), False).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(special & is_text):
        found[k] = escape_text(trim_lines(found[k]))
    return found


def _html(rows: DataFrame, key: str) -> DataFrame:
    """:func:`_folded` for HTML. Subtrees right below the root, and items of lists there, are folded once for all that differ in texts alone."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        alike, known = _Alike(), {}
        now, fold = None, None
        for batch in batches:
            if len(batch) == 0:
                continue
            if len(alike.rows) > _KEPT or len(known) > _KEPT or alike.chars > _KEPT_CHARS:
                alike, known = _Alike(), {}
            numbers, first, is_text, items, levels = alike(batch.column("_head"), batch.column("value"))
            texts, raw, looks = _texts(batch.column("value"), is_text), numbers.tobytes(), alike.rows
            cuts = np.flatnonzero(first | (levels <= 1) | (items & (levels == 2)))
            # Rows ahead of the first cut, and behind the last one, whose end isn't seen, go one by one.
            bounds = [*([0] if len(cuts) == 0 or cuts[0] else []), *cuts.tolist(), len(batch)]
            begins, depths = first[bounds[:-1]].tolist(), levels[bounds[:-1]].tolist()
            starts = iter(values(batch.column(key).take(pa.array(np.flatnonzero(first)))))
            keys, made = [], []
            for nth, at in enumerate(bounds[:-1]):
                end = bounds[nth + 1]
                if begins[nth]:
                    if fold is not None:
                        keys.append(now)
                        made.append(fold.end())
                    now, fold = next(starts), HtmlFold()
                if end < len(batch) and (begins[nth + 1] or depths[nth + 1] <= depths[nth]):
                    up = fold.above(depths[nth])
                    look = (raw[4 * at : 4 * end], fold.context(up))
                    subtree = known.get(look, look)
                    if subtree is look:
                        subtree = known[look] = fold.subtree([looks[k] for k in numbers[at:end].tolist()])
                    if subtree is not None:
                        fold.put(up, subtree, texts, at)
                        continue
                for k, number in enumerate(numbers[at:end].tolist(), at):
                    look = looks[number]
                    if look[0] == "text":
                        fold.text(look[1], texts[k])
                    else:
                        fold.row(*look)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), pa.array(made, pa.string())], [key, "html"])
            key_type = batch.column(key).type
        if fold is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], key_type), pa.array([fold.end()], pa.string())], [key, "html"])

    laid = rows.sortWithinPartitions(key, "node_id").select(key, _head(F.col("_nth") == 1).alias("_head"), "value")
    return laid.mapInArrow(run, f"`{key}` {kind}, html string")


def nodes_to_html(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``html`` in the unified dialect, from the rows of :func:`nodes` or of any edit of them.

    The rows need ``node_id`` in preorder, ``depth_in_tree`` and ``type``. ``tag`` (string) and ``properties`` (map), where the
    table has them, give nodes another element and more attributes, as a plug-in's hName and hProperties do. A
    reference takes the first definition among the rows; without one it is its source's text again. Documents without
    rows have no row. A document's rows meet in one partition, and pass it sorted.
    """
    return _html(_laid(tree.select(key, "node_id", "type", "depth_in_tree", *_columns(tree, ["value"]), _look(tree).alias("_look")), key), key)


def nodes_to_json(tree: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``json``, likewise; rows with places have a ``position``."""
    rows = _laid(tree, key).select(key, "_nth", "node_id", "type", "depth_in_tree", *_columns(tree, [*JSON_COLUMNS, *PLACES]))
    return _folded(rows, key, (*JSON_COLUMNS, *PLACES), JsonFold, "json")
