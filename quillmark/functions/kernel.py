"""The kernel as Arrow functions of a text column.

They are scalar and deterministic, so filters on other columns and column pruning pass through them
to the scan. Each Python worker keeps one kernel object per set of options.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel.chars import decode_references
from ..kernel.chars import label_key as fold_label
from ..kernel.html import HtmlRenderer
from ..kernel.shapes import Shapes
from ..kernel.sinks import UnifiedRenderer, to_json
from ..kernel.tree import Points, TreeBuilder, add_text, select
from ..options import Options

_STRINGS = ("value", "url", "title", "alt", "lang", "meta", "identifier", "label", "reference_type")
_PLACES = ("start_line", "start_column", "start_offset", "end_line", "end_column", "end_offset")
_PAIRS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_ARROW = pa.struct(
    [("node_id", pa.int32()), ("parent_id", pa.int32()), ("ordinal", pa.int32()), ("depth_in_tree", pa.int32()), ("subtree_end", pa.int32()), ("type", pa.string())]
    + [(name, pa.string()) for name in _STRINGS]
    + [("depth", pa.int32()), ("ordered", pa.bool_()), ("start", pa.int64()), ("spread", pa.bool_()), ("checked", pa.bool_()),
       ("align", pa.list_(pa.string())), ("name", pa.string()), ("attributes", _PAIRS), ("directive_label", pa.bool_()), ("text", pa.string()), ("cells", pa.list_(pa.string()))]
    + [(name, pa.int32()) for name in _PLACES]
)
_SPARK = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.bool_(): T.BooleanType()}
#: A node, as the struct that :func:`md_nodes_array` has an array of.
NODE = T.StructType(
    [T.StructField(f.name, _SPARK.get(f.type) or (T.ArrayType(T.StringType()) if f.name in ("align", "cells") else T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))) for f in _ARROW]
)


@lru_cache(64)
def _renderer(flags: int, emoji: tuple | None = None) -> HtmlRenderer:
    return HtmlRenderer(Options.from_flags(flags), **({} if emoji is None else {"emoji": dict(emoji)}))


@lru_cache(64)
def _builder(flags: int, inline: bool) -> TreeBuilder:
    return TreeBuilder(Options.from_flags(flags), inline=inline)


def _strings(convert: Callable[[str], str]):
    """An Arrow function of one string column (null stays null)."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else convert(t) for t in texts.to_pylist()], pa.string())

    return run


_NODE = {"node_id": "id", "parent_id": "parent", "ordinal": "ordinal", "depth_in_tree": "level", "subtree_end": "last", "type": "type"}
#: Nodes that are in Python's objects and in one Arrow batch at a time, besides those of one document.
CHUNK_NODES = 1 << 14


def _table(text: str, builder: TreeBuilder, types: Collection[str] | None, inline: bool, positions: bool) -> dict[str, list]:
    """The columns of a text's nodes; attributes that no node has are left out."""
    tree = builder.build(text)
    if inline:
        add_text(tree)
    rows = select(tree, types)
    columns = {name: [getattr(r, own) for r in rows] for name, own in _NODE.items()}
    for k, r in enumerate(rows):
        for name, value in r.attrs.items():
            if value is not None:
                if name not in columns:
                    columns[name] = [None] * len(rows)
                columns[name][k] = [{"key": a, "value": b} for a, b in value] if name == "attributes" else value
    if positions:
        at = Points(text)
        places = [(None,) * len(_PLACES) if r.span is None else at(r.span[0]) + at(r.span[1]) for r in rows]
        columns.update(zip(_PLACES, map(list, zip(*places))))
    return columns


@lru_cache(16)
def _tables(flags: int, types: frozenset[str] | None, inline: bool, positions: bool) -> Callable[[str], dict[str, list]]:
    """:func:`_table` for texts, by shapes where words can't matter."""
    builder = _builder(flags, inline)

    def table(text: str) -> dict[str, list]:
        return _table(text, builder, types, inline, positions)

    return table if flags or positions else Shapes(table, lambda text: _table(text, builder, None, inline, False), types).columns


def node_columns(text: str, flags: int = 0) -> dict[str, list]:
    """The columns of a text's nodes, without those that are null in all of them; for Arrow functions that need no node rows."""
    return _tables(flags, None, True, False)(text)


def nodes_arrays(texts: list[str | None], options: Options, types: Collection[str] | None, inline: bool, positions: bool) -> Iterator[pa.Array]:
    """The trees of texts as Arrow arrays of arrays of nodes, of about ``CHUNK_NODES`` nodes each."""
    table = _tables(options.flags, None if types is None else frozenset(types), inline, positions)
    columns, offsets, mask, n = {}, [0], [], 0

    def chunk() -> pa.Array:
        for values in columns.values():
            values += [None] * (n - len(values))
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW]
        values = pa.StructArray.from_arrays(arrays, fields=list(_ARROW))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(mask, pa.bool_()))

    for text in texts:
        if text is not None:
            found = table(text)
            for name, values in found.items():
                mine = columns.get(name)
                if mine is None:
                    mine = columns[name] = []
                if len(mine) < n:
                    mine += [None] * (n - len(mine))
                mine += values
            n += len(found["node_id"])
        offsets.append(n)
        mask.append(text is None)
        if n >= CHUNK_NODES:
            yield chunk()
            columns, offsets, mask, n = {}, [0], [], 0
    if mask or not texts:
        yield chunk()


def nodes_array(texts: list[str | None], options: Options, types: Collection[str] | None, inline: bool, positions: bool) -> pa.Array:
    """The trees of texts as one Arrow array of arrays of nodes."""
    return pa.concat_arrays(list(nodes_arrays(texts, options, types, inline, positions)))


def md_nodes_array(text: Column, options: Options = Options(), types: Collection[str] | None = None, inline: bool = True, positions: bool = False) -> Column:
    """A document's nodes in preorder (null: null).

    Leaf blocks have their ``text``, table rows their ``cells`` (not with ``inline=False``). ``types`` keeps nodes of these types, ``inline=False`` parses blocks alone, and without
    ``positions`` the place columns are null: what a query does not need is not built. A batch of texts comes out in pieces, so a task
    holds the nodes of few documents at once, however many texts Spark sends.
    """
    kept = None if types is None else frozenset(types)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from nodes_arrays(texts.to_pylist(), options, kept, inline, positions)

    return F.arrow_udf(run, T.ArrayType(NODE))(text)


def md_to_html(text: Column, options: Options = Options(), emoji: dict[str, str] | None = None) -> Column:
    """HTML in the dialect of CommonMark's reference output (null: null). ``emoji``: shortcodes instead of the built-in ones."""
    flags, names = options.flags, None if emoji is None else tuple(sorted(emoji.items()))
    return F.arrow_udf(_strings(lambda t: _renderer(flags, names).render(t)), T.StringType())(text)


def md_to_unified_html(text: Column, options: Options = Options(), element: Callable[[str, dict], tuple[str | None, dict] | None] | None = None) -> Column:
    """HTML of the tree, in the dialect of the unified ecosystem (null: null). ``element``: tags and attributes of nodes by a plug-in, see :class:`UnifiedRenderer`."""
    flags = options.flags
    return F.arrow_udf(_strings(lambda t: UnifiedRenderer(element).render(_builder(flags, True).build(t))), T.StringType())(text)


def md_to_json(text: Column, options: Options = Options(), positions: bool = False) -> Column:
    """The tree as JSON (null: null); ``parse_json`` makes a variant of it."""
    flags = options.flags
    return F.arrow_udf(_strings(lambda t: to_json(_builder(flags, True).build(t), t if positions else None)), T.StringType())(text)


def md_to_html_each(texts: Column, options: Options = Options()) -> Column:
    """:func:`md_to_html` of each text of an array (null: null)."""
    flags = options.flags

    def run(lists: pa.Array) -> pa.Array:
        render = _renderer(flags).render
        return pa.array([None if row is None else [None if t is None else render(t) for t in row] for row in lists.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(texts)


def label_key(label: Column) -> Column:
    """What reference labels are compared by (null: null): the kernel's own folding."""
    return F.arrow_udf(_strings(fold_label), T.StringType())(label)


def decoded(text: Column) -> Column:
    """Character references resolved, unknown ones and those without a semicolon as they are (null: null)."""
    return F.arrow_udf(_strings(decode_references), T.StringType())(text)


_BLOCK_COLUMNS = ("node_id", "parent_id", "ordinal", "depth_in_tree", "subtree_end", "type", "depth", "value", "lang", "start_line", "end_line")


def blocks_table_function(key: str = "doc_id bigint", options: Options = Options()):
    """A table function of a table: its first column is the key (name and type as given), its second the text; one row for each block.

    It takes and gives whole Arrow batches, and needs no exchange: ``select * from f(table(select doc_id, text from d))``.
    """
    flags = options.flags

    class Blocks:
        def eval(self, batch: pa.RecordBatch):
            at = 0
            for trees in nodes_arrays(batch.column(1).to_pylist(), Options.from_flags(flags), None, False, True):
                nodes, keys = trees.flatten(), batch.column(0).slice(at, len(trees))
                at += len(trees)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pc.list_parent_indices(trees)), *(nodes.field(n) for n in _BLOCK_COLUMNS)], [key.split()[0], *_BLOCK_COLUMNS])

    kinds = ", ".join(f"{n} {_SPARK[_ARROW.field(n).type].simpleString()}" for n in _BLOCK_COLUMNS)
    return F.arrow_udtf(Blocks, returnType=f"{key}, {kinds}")


def blocks_function(options: Options = Options()):
    """A table function for lateral joins: one row for each block of a text (null: none), with its lines.

    Spark takes no Arrow function there, so it goes row by row; :func:`blocks_table_function` takes tables in batches.
    """
    flags = options.flags

    class Blocks:
        def eval(self, text: str):
            if text is None:
                return
            at = Points(text)
            for r in _builder(flags, False).build(text):
                lines = (None, None) if r.span is None else (at(r.span[0])[0], at(r.span[1])[0])
                yield (r.id, r.parent, r.type, r.attrs.get("depth"), r.attrs.get("value"), *lines)

    kind = "node_id int, parent_id int, type string, depth int, value string, start_line int, end_line int"
    return F.udtf(Blocks, returnType=kind, useArrow=True)


def register(spark: SparkSession, options: Options = Options(), prefix: str = "md_") -> None:
    """SQL functions ``md_to_html``, ``md_to_unified_html``, ``md_to_json``, ``md_nodes``, for ``lateral`` ``md_blocks``, and for ``table(...)`` of doc_id and text ``md_block_table``."""
    flags = options.flags
    convert = {
        "to_html": lambda t: _renderer(flags).render(t),
        "to_unified_html": lambda t: UnifiedRenderer().render(_builder(flags, True).build(t)),
        "to_json": lambda t: to_json(_builder(flags, True).build(t)),
    }
    for name, function in convert.items():
        spark.udf.register(prefix + name, F.arrow_udf(_strings(function), T.StringType()))

    def nodes(texts: pa.Array) -> pa.Array:
        return nodes_array(texts.to_pylist(), options, None, True, False)

    spark.udf.register(prefix + "nodes", F.arrow_udf(nodes, T.ArrayType(NODE)))
    spark.udtf.register(prefix + "blocks", blocks_function(options))
    spark.udtf.register(prefix + "block_table", blocks_table_function(options=options))
