"""The syntax tree as rows in preorder: what a node table is made of."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Collection

from ..options import Options
from . import autolink
from .blocks import Block, BlockParser, split_cells
from .emoji import SHORTCODES
from .inline import InlineParser, Node, plain_text

#: The attributes a node may have; a node keeps only those of its type.
ATTRIBUTES = (
    "value", "url", "title", "alt", "lang", "meta", "identifier", "label", "reference_type", "depth", "ordered",
    "start", "spread", "checked", "align", "name", "attributes", "directive_label", "text", "cells",
)
#: Blocks whose children are inlines.
LEAVES = frozenset("paragraph heading tableCell defListTerm defListDescription leafDirective".split())
BLOCK_TYPES = frozenset(
    "root paragraph heading blockquote list listItem thematicBreak code html yaml toml definition footnoteDefinition "
    "defList defListTerm defListDescription leafDirective containerDirective table tableRow tableCell".split()
)
INLINE_TYPES = frozenset(
    "text emphasis strong delete inlineCode break html link image linkReference imageReference footnoteReference textDirective".split()
)
_TASK = re.compile(r"\[([ xX])\][ \t\n](?=[\s\S]*\S)")
_INFO = re.compile(r"(\S+)[ \t]*([\s\S]*)")


class Row:
    """A node: its place in the tree, its place in the source (None where it has none), its attributes."""

    __slots__ = ("id", "parent", "ordinal", "level", "last", "type", "span", "attrs")

    def __init__(self, number: int, parent: int | None, ordinal: int, level: int, kind: str, span: tuple[int, int] | None, attrs: dict):
        self.id, self.parent, self.ordinal, self.level, self.last = number, parent, ordinal, level, number
        self.type, self.span, self.attrs = kind, span, attrs


class Points:
    """Source offsets as (line, column, offset) in UTF-16 units, as editors and browsers count."""

    def __init__(self, text: str):
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.wide = [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", text)]

    def _units(self, at: int) -> int:
        return at + bisect_right(self.wide, at - 1) if self.wide else at

    def __call__(self, at: int) -> tuple[int, int, int]:
        line = bisect_right(self.lines, at)
        units = self._units(at)
        return line, units - self._units(self.lines[line - 1]) + 1, units


class TreeBuilder:
    """Builds the rows of documents; one object serves many. ``inline=False`` leaves out what leaves hold."""

    def __init__(self, options: Options | None = None, emoji: dict[str, str] | None = None, inline: bool = True):
        self.options = options or Options()
        self.emoji = SHORTCODES if emoji is None else emoji
        self.with_inline = inline

    def build(self, text: str) -> list[Row]:
        parser = BlockParser(text, self.options)
        self.inline = InlineParser(self.options, parser.references, parser.footnotes, self.emoji, tree=True)
        self.rows: list[Row] = []
        self.kids: list[int] = []
        todo: list[tuple[Block, int | None]] = [(parser.root, None)]
        while todo:
            block, parent = todo.pop()
            number = self._block(block, parent)
            if number is not None:
                todo.extend((kid, number) for kid in reversed(block.kids))
        for row in reversed(self.rows):
            if row.parent is not None and row.last > self.rows[row.parent].last:
                self.rows[row.parent].last = row.last
        return self.rows

    def _add(self, kind: str, parent: int | None, span: tuple[int, int] | None, **attrs) -> int:
        number = len(self.rows)
        ordinal, level = 0, 0
        if parent is not None:
            ordinal, level = self.kids[parent], self.rows[parent].level + 1
            self.kids[parent] += 1
        self.rows.append(Row(number, parent, ordinal, level, kind, span, attrs))
        self.kids.append(0)
        return number

    def _block(self, b: Block, parent: int | None) -> int | None:
        """Add a block; its number if its children are blocks."""
        kind, span, data = b.kind, (b.beg, b.end), b.data
        if kind == "document":
            return self._add("root", None, span)
        if kind in ("blockquote", "defList"):
            return self._add(kind, parent, span)
        if kind == "list":
            return self._add("list", parent, span, ordered=data["ordered"], start=data["start"], spread=data["spread"])
        if kind == "listItem":
            task = None
            first = b.kids[0] if b.kids else None
            if self.options.tasklist and first is not None and first.kind == "paragraph":
                m = _TASK.match(first.text)
                if m:
                    task = m[1] != " "
                    first.data["skip"] = m.end()
            return self._add("listItem", parent, span, spread=data["spread"], checked=task)
        if kind == "footnoteDefinition":
            return self._add(kind, parent, span, identifier=data["identifier"], label=data["label"])
        if kind == "containerDirective":
            number = self._add(kind, parent, span, name=data["name"], attributes=data["attributes"])
            if "label" in data:
                text, at = data["label"]
                self._leaf("paragraph", number, (at - 1, at + len(text) + 1), text, [(0, at)], directive_label=True)
            return number
        if kind == "paragraph":
            skip = data.get("skip", 0)
            begin = _source(b.segments, skip) if skip else b.segments[0][1]
            self._leaf("paragraph", parent, (begin, b.end), b.text, b.segments, skip)
        elif kind == "heading":
            self._leaf("heading", parent, span, b.text, b.segments, depth=data["depth"])
        elif kind == "thematicBreak":
            self._add(kind, parent, span)
        elif kind in ("fence", "indented"):
            m = _INFO.match(data.get("info", ""))
            self._add("code", parent, span, lang=m[1] if m else None, meta=(m[2] or None) if m else None, value=b.text.removesuffix("\n"))
        elif kind in ("html", "yaml", "toml"):
            self._add(kind, parent, span, value=b.text)
        elif kind == "definition":
            self._add(kind, parent, span, **data)
        elif kind == "defListTerm":
            at = 0
            for line in b.text.split("\n"):
                begin = _source(b.segments, at)
                self._leaf("defListTerm", parent, (begin, begin + len(line)), line, [(0, begin)])
                at += len(line) + 1
        elif kind == "defListDescription":
            self._leaf(kind, parent, span, b.text, b.segments or [(0, b.beg)], spread=data["spread"])
        elif kind == "leafDirective":
            text, at = data.get("label", ("", b.end))
            self._leaf(kind, parent, span, text, [(0, at)], name=data["name"], attributes=data["attributes"])
        elif kind == "table":
            self._table(b, parent)
        return None

    def _table(self, b: Block, parent: int | None) -> None:
        lines = b.data["rows"]
        number = self._add("table", parent, (b.beg, lines[-1][0] + len(lines[-1][1])), align=b.data["align"])
        for k, (at, line) in enumerate(lines):
            if k == 1:
                continue
            cells = split_cells(line)
            row = self._add("tableRow", number, (at + len(line) - len(line.lstrip(" \t")), at + len(line)))
            for j, (lo, hi) in enumerate(cells):
                raw = line[lo:hi]
                inner = lo + len(raw) - len(raw.lstrip(" \t"))
                # Cells tile their row: each begins at the pipe before it, the last ends with the line.
                begin = at + (lo - 1 if j or line[lo - 1 : lo] == "|" else lo)
                end = at + (hi if j < len(cells) - 1 else len(line))
                self._leaf("tableCell", row, (begin, end), raw.strip(" \t"), [(0, at + inner)])

    def _leaf(self, kind: str, parent: int | None, span, text: str, segments, skip: int = 0, **attrs) -> None:
        number = self._add(kind, parent, span, **attrs)
        if not self.with_inline:
            return
        body = text[skip:]
        if not body:
            return
        if self.inline.plain(body):
            self._text(number, body, (_source(segments, skip), _source(segments, skip + len(body) - 1) + 1), False)
            return
        todo: list[tuple[Node, int, bool]] = [(n, number, False) for n in reversed(self.inline.parse(body))]
        while todo:
            n, up, linked = todo.pop()
            place = (_source(segments, n.beg + skip), _source(segments, max(n.beg, n.end - 1) + skip) + 1)
            kind, extra = n.type, n.extra or {}
            if kind == "text":
                self._text(up, n.value, place, linked)
                continue
            attrs = {}
            if kind in ("inlineCode", "html"):
                attrs["value"] = n.value
            elif kind in ("link", "image"):
                attrs.update(url=extra["url"], title=extra["title"])
            elif kind in ("linkReference", "imageReference"):
                attrs.update(identifier=extra["identifier"], label=extra["label"], reference_type=extra["kind"])
            elif kind == "footnoteReference":
                attrs.update(identifier=extra["identifier"], label=extra["label"])
            elif kind == "textDirective":
                attrs.update(name=extra["name"], attributes=extra["attributes"])
            if kind.startswith("image"):
                attrs["alt"] = plain_text(n.kids)
            number = self._add(kind, up, place, **attrs)
            if n.kids and not kind.startswith("image"):
                todo.extend((kid, number, linked or kind.startswith("link")) for kid in reversed(n.kids))

    def _text(self, parent: int, value: str, place: tuple[int, int], linked: bool) -> None:
        """A text; with autolinks the addresses a second pass finds in it, whose pieces have no place."""
        pieces = autolink.late(value) if self.options.autolink and not linked else ()
        if all(dest is None for _, dest in pieces):
            self._add("text", parent, place, value=value)
            return
        for piece, dest in pieces:
            if dest is None:
                self._add("text", parent, None, value=piece)
            else:
                self._add("text", self._add("link", parent, None, url=dest, title=None), None, value=piece)


def _source(segments: list[tuple[int, int]], offset: int) -> int:
    """The source offset of a text offset."""
    at, source = segments[bisect_right(segments, offset, key=lambda s: s[0]) - 1]
    return source + offset - at


def add_text(rows: list[Row]) -> None:
    """Give each leaf the ``text`` in it (a break is a line end), and what holds a leaf what it shows of it.

    A task item gets the text of its first paragraph; a table's row its ``cells``, padded or cut to the head's
    width, and the table's ``align``. So relations need no join of a block with its inlines.
    """
    leaf, pieces = None, []
    for row in [*rows, None]:
        if leaf is not None and (row is None or row.id > leaf.last):
            leaf.attrs["text"], leaf = "".join(pieces), None
        if row is None:
            break
        if row.type in LEAVES:
            leaf, pieces = row, []
        elif leaf is not None and row.type in ("text", "inlineCode", "break"):
            pieces.append(row.attrs.get("value", "\n"))
    for row in rows:
        up = rows[row.parent] if row.parent is not None else None
        if row.type == "tableRow":
            row.attrs.update(align=up.attrs["align"], cells=[""] * len(up.attrs["align"]))
        elif row.type == "tableCell" and row.ordinal < len(up.attrs["cells"]):
            up.attrs["cells"][row.ordinal] = row.attrs["text"]
        elif row.type == "paragraph" and up.type == "listItem" and not row.ordinal and up.attrs["checked"] is not None:
            up.attrs["text"] = row.attrs["text"]


def select(rows: list[Row], types: Collection[str] | None) -> list[Row]:
    """The rows of the given types, numbered as in the whole tree."""
    return rows if types is None else [r for r in rows if r.type in types]
