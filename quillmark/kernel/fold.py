"""A tree's rows, in preorder, folded into HTML of the unified dialect or JSON: a stack of open frames, one row at a time.

What a node's look takes from further on in its document is put into the HTML afterwards: a reference's target, which may be defined at the end, and
what differs in a loose list, which any of its items makes loose. So besides the HTML so far only open nodes, references and definitions are kept, and rows may come from
the parser or from any edit of them.
"""

from __future__ import annotations

import json
import re

from .sinks import _CHILDLESS, _EMPTY, _ELEMENTS, _JSON, escape_attribute, escape_text, escape_uri, trim_lines

#: Columns that the folds read, besides ``type`` and ``depth_in_tree``.
HTML_COLUMNS = (
    "value", "url", "title", "alt", "lang", "identifier", "label", "reference_type", "depth", "ordered", "start", "spread", "align",
    "directive_label", "tag", "properties",
)
_REFERENCES = frozenset(("linkReference", "imageReference", "definition"))
JSON_COLUMNS = tuple(sorted({n for names in _JSON.values() for n in names} | {"directive_label"}))
PLACES = ("start_line", "start_column", "start_offset", "end_line", "end_column", "end_offset")
_NEWLINE = re.compile(r"\r?\n|\r")


class Frame:
    """An open node: what closes it, and what its children need to know."""

    __slots__ = ("level", "kind", "close", "loose", "shown", "last", "align", "hidden", "tight", "list", "later", "wide", "slots")

    def __init__(self, level: int, kind: str, close: str = "", loose: bool = False, align=None, hidden: bool = False, tight: bool = False):
        self.level, self.kind, self.close, self.loose = level, kind, close, loose
        self.shown, self.last, self.align, self.hidden, self.tight = 0, "", align, hidden, tight
        self.list: Frame | None = None  # of an item
        self.later: list[tuple[int, object]] = []  # of a list: where its HTML differs if it is loose, and how (a text, or a subtree's own list of these)
        self.wide = ""  # what closes a paragraph of an item if the list is loose
        self.slots: list | None = None  # of a link reference: where its tags stand


class HtmlFold:
    """Feed a document's rows by :meth:`row`; :meth:`end` gives its HTML."""

    def __init__(self):
        self.out: list[str] = []
        self.top = Frame(-1, "root")  # stands above all, also where the rows have no root
        self.stack: list[Frame] = []
        self.targets: dict[str, tuple[str, str | None]] = {}
        self.open: list[list] = []  # references: label, attributes, places of the opening and the closing tag

    def row(self, kind: str, level: int, attrs: dict) -> None:
        up = self.above(level)
        if kind == "definition":
            self.targets.setdefault(attrs["identifier"], (attrs["url"] or "", attrs["title"]))
        if up.hidden or kind in _EMPTY or kind == "footnoteReference":
            self.stack.append(Frame(level, kind, hidden=True))
            return
        frame = self._cell(up, level, attrs) if up.kind == "tableRow" else self._open(up, kind, level, attrs)
        self.stack.append(frame)

    def text(self, level: int, shown: object) -> None:
        """A text's row; ``shown`` is its HTML."""
        up = self.above(level)
        if up.kind == "tableRow" and not up.hidden:
            self.stack.append(self._cell(up, level, {}))
            return
        if not up.hidden:
            self._between(up, "text")
            self.out.append(shown)
        self.stack.append(Frame(level, "text", hidden=up.hidden))

    def above(self, level: int) -> Frame:
        """What a row of this level is in: deeper nodes are closed."""
        while self.stack and self.stack[-1].level >= level:
            self._close(self.stack.pop())
        return self.stack[-1] if self.stack else self.top

    def end(self) -> str:
        self.above(-1)
        for label, attrs, opening, closing in self.open:
            target = self.targets.get(label)
            if target is not None:
                tags = self._target(closing is None, attrs, *target)
                self.out[opening] = tags[0]
                if closing is not None:
                    self.out[closing] = tags[1]
        return "".join(self.out)

    def _tags(self, attrs: dict, tag: str | None, **own: str) -> tuple[str, str]:
        tag = attrs.get("tag") or tag
        for name, value in attrs.get("properties") or ():
            own.pop(name, None)
            if value is not None:
                own[name] = escape_attribute(value)
        return ("", "") if tag is None else (f"<{tag}" + "".join(f' {n}="{v}"' for n, v in own.items()) + ">", f"</{tag}>")

    def _between(self, up: Frame, kind: str) -> bool:
        """What stands before a child; True if a paragraph is shown without its tags."""
        tight = False
        if up.kind in ("root", "footnoteDefinition", "blockquote", "list"):
            if up.shown:
                self.out.append("\n")
        elif up.kind == "listItem":
            tight = kind == "paragraph" and not (up.list or up).loose
            if up.shown or not tight:
                self.out.append("\n")
            elif up.list:
                up.list.later.append((len(self.out), "\n"))
                self.out.append("")
        elif up.kind == "defList" and up.shown:
            self.out.append("\n")
        up.shown += 1
        up.last = kind
        return tight

    def _open(self, up: Frame, kind: str, level: int, attrs: dict) -> Frame:
        out, tight = self.out, kind != "root" and self._between(up, kind)
        if kind in ("root", "footnoteDefinition"):
            return Frame(level, kind)
        if kind == "text":
            out.append(escape_text(trim_lines(attrs["value"])))
            return Frame(level, kind)
        if kind == "inlineCode":
            opening, closing = self._tags(attrs, "code")
            out.append(opening + escape_text(_NEWLINE.sub(" ", attrs["value"])) + closing)
            return Frame(level, kind)
        if kind == "blockquote":
            opening, closing = self._tags(attrs, "blockquote")
            out.append(opening + "\n")
            return Frame(level, kind, closing)
        if kind == "list":
            start = {"start": str(attrs["start"])} if attrs["ordered"] and attrs["start"] != 1 else {}
            opening, closing = self._tags(attrs, "ol" if attrs["ordered"] else "ul", **start)
            out.append(opening + "\n")
            return Frame(level, kind, "\n" + closing, loose=bool(attrs["spread"]))
        if kind == "listItem":
            opening, closing = self._tags(attrs, "li")
            out.append(opening)
            frame = Frame(level, kind, closing, loose=bool(attrs["spread"]))
            if up.kind == "list":
                frame.list = up
                up.loose = up.loose or frame.loose
            return frame
        if kind == "code":
            words = (attrs["lang"] or "").split()
            opening, closing = self._tags(attrs, "code", **({"class": f"language-{escape_attribute(words[0])}"} if words else {}))
            out.append(f"<pre>{opening}{escape_text(attrs['value'])}" + ("\n" if attrs["value"] else "") + f"{closing}</pre>")
            return Frame(level, kind)
        if kind in ("thematicBreak", "break"):
            out.append(self._tags(attrs, "hr")[0] if kind == "thematicBreak" else self._tags(attrs, "br")[0] + "\n")
            return Frame(level, kind)
        if kind in _ELEMENTS or kind == "heading":
            bare = attrs.get("directive_label") or tight
            opening, closing = ("", "") if tight else self._tags(attrs, None if bare else _ELEMENTS.get(kind) or f"h{attrs['depth']}")
            frame = Frame(level, kind, closing)
            if tight and up.list:
                wide, frame.wide = self._tags(attrs, None if attrs.get("directive_label") else "p")
                frame.list = up.list
                up.list.later.append((len(out), wide))
            out.append(opening)
            return frame
        if kind in ("link", "image"):
            opening, closing = self._target(kind == "image", attrs, attrs["url"], attrs["title"])
            out.append(opening)
            return Frame(level, kind, closing, hidden=kind == "image")
        if kind in ("linkReference", "imageReference"):
            slots = [attrs["identifier"], attrs, len(out), None]
            self.open.append(slots)
            suffix = {"shortcut": "]", "collapsed": "][]"}.get(attrs["reference_type"], f"][{attrs['label'] or attrs['identifier']}]")
            if kind == "imageReference":
                out.append(escape_text(f"![{attrs['alt']}{suffix}"))
                return Frame(level, kind, hidden=True)
            out.append("[")
            frame = Frame(level, kind, escape_text(suffix))
            frame.slots = slots
            return frame
        if kind == "defList":
            opening, closing = self._tags(attrs, "dl")
            out.append(opening + "\n")
            return Frame(level, kind, closing)
        if kind == "table":
            opening, closing = self._tags(attrs, "table")
            out.append(opening + "\n")
            return Frame(level, kind, closing, align=attrs["align"] or [])
        if kind == "tableRow":
            head = up.shown == 1
            opening, closing = self._tags(attrs, "tr")
            out.append(("<thead>\n" if head else "<tbody>\n" if up.shown == 2 else "") + opening + "\n")
            return Frame(level, kind, closing + "\n" + ("</thead>\n" if head else ""), align=up.align or [], tight=head)
        opening, closing = self._tags(attrs, None)
        out.append(opening)
        return Frame(level, kind, closing)

    def _cell(self, row: Frame, level: int, attrs: dict) -> Frame:
        if row.shown >= len(row.align):  # beyond the head's width
            return Frame(level, "tableCell", hidden=True)
        align = row.align[row.shown]
        opening, closing = self._tags(attrs, "th" if row.tight else "td", **({"align": align} if align else {}))
        row.shown += 1
        self.out.append(opening)
        return Frame(level, "tableCell", closing + "\n")

    def _target(self, image: bool, attrs: dict, url: str, title: str | None) -> tuple[str, str]:
        more = {} if title is None else {"title": escape_attribute(title)}
        if image:
            return self._tags(attrs, "img", src=escape_uri(url), alt=escape_attribute(attrs["alt"] or ""), **more)[0], ""
        return self._tags(attrs, "a", href=escape_uri(url), **more)

    def _close(self, frame: Frame) -> None:
        out, kind = self.out, frame.kind
        if frame.hidden:
            return
        if kind == "blockquote" and frame.shown:
            out.append("\n")
        elif kind == "listItem" and frame.shown:
            if frame.last != "paragraph" or (frame.list or frame).loose:
                out.append("\n")
            elif frame.list:
                frame.list.later.append((len(out), "\n"))
                out.append("")
        elif kind == "paragraph" and frame.list:
            frame.list.later.append((len(out), frame.wide))
        elif kind == "list" and frame.loose:
            self._loosen(frame.later, 0)
        elif kind == "linkReference" and frame.slots:
            frame.slots[3] = len(out)
        elif kind == "defList" and frame.shown:
            out.append("\n")
        elif kind == "table" and frame.shown > 1:
            out.append("</tbody>\n")
        elif kind == "tableRow":
            tag = "th" if frame.tight else "td"
            out += [(f'<{tag} align="{a}">' if a else f"<{tag}>") + f"</{tag}>\n" for a in frame.align[frame.shown :]]
        out.append(frame.close)

    def _loosen(self, later: list[tuple[int, object]], base: int) -> None:
        for at, how in later:
            if isinstance(how, str):
                self.out[base + at] = how
            else:
                self._loosen(how, base + at)

    def subtree(self, rows: list[tuple[str, int, dict]]) -> Subtree | None:
        """What rows, of which the first one is above the others, add here, with holes for texts; None if they depend on more than :meth:`context` tells."""
        level = rows[0][1]
        if any(kind in _REFERENCES or below <= level for kind, below, _ in rows[1:]) or rows[0][0] in _REFERENCES:
            return None
        up = self.above(level)
        if up.kind in ("table", "tableRow"):
            return None
        aside, mine = HtmlFold(), Frame(up.level, up.kind, loose=up.loose, hidden=up.hidden, tight=up.tight)
        mine.list, mine.shown = up.list and Frame(up.list.level, "list", loose=up.list.loose), up.shown
        aside.stack.append(mine)
        for k, (kind, below, attrs) in enumerate(rows):
            if kind == "text":
                aside.text(below, k)
            else:
                aside.row(kind, below, attrs)
        aside.above(level)
        mine.shown -= up.shown
        return Subtree(aside.out, mine)

    def context(self, up: Frame) -> tuple:
        """All of the frame above that a subtree's HTML follows from."""
        return up.kind, up.hidden, up.loose, up.list is not None, up.list is not None and up.list.loose, up.shown > 0

    def put(self, up: Frame, subtree: Subtree, texts: list[str], at: int) -> None:
        """Add a subtree, whose rows' texts begin ``at`` this place."""
        pieces, out = subtree.pieces.copy(), self.out
        for place, nth in subtree.holes:
            pieces[place] = texts[at + nth]
        if subtree.later:
            up.later.append((len(out), subtree.later))
        if subtree.item_later:
            up.list.later.append((len(out), subtree.item_later))
        out += pieces
        up.shown, up.last, up.loose = up.shown + subtree.shown, subtree.last or up.last, subtree.loose


class Subtree:
    """The HTML of rows that are alike but for their texts: pieces, of which ``holes`` (place, row) are texts, and what they change above."""

    __slots__ = ("pieces", "holes", "later", "item_later", "shown", "last", "loose")

    def __init__(self, out: list, up: Frame):
        self.later, self.item_later = up.later, up.list.later if up.list else []
        fixed = {at for at, _ in [*self.later, *self.item_later]}
        self.pieces, self.holes, moved, run = [], [], {}, False
        for at, piece in enumerate(out):
            alone = at in fixed or isinstance(piece, int)
            if run and not alone:
                self.pieces[-1] += piece
                continue
            run = not alone
            moved[at] = len(self.pieces)
            if isinstance(piece, int):
                self.holes.append((len(self.pieces), piece))
                piece = ""
            self.pieces.append(piece)
        self.later, self.item_later = ([(moved[at], how) for at, how in found] for found in (self.later, self.item_later))
        self.shown, self.last, self.loose = up.shown, up.last, up.loose


class JsonFold:
    """The same for JSON; a row with places has a ``position``."""

    def __init__(self):
        self.out: list[str] = []
        self.stack: list[list] = []  # level, what closes it (None: it can't have children), number of children

    def row(self, kind: str, level: int, attrs: dict) -> None:
        self._close(level)
        if self.stack:
            if self.stack[-1][1] is None:  # below what has no children
                self.stack.append([level, None, 0])
                return
            if self.stack[-1][2]:
                self.out.append(",")
            self.stack[-1][2] += 1
        parts = [f'"type":"{kind}"']
        for name in _JSON.get(kind, ()):
            value = attrs[name]
            if name == "attributes":
                value = {pair["key"]: pair["value"] for pair in value or ()}
            parts.append(f'"{"referenceType" if name == "reference_type" else name}":{json.dumps(value, ensure_ascii=False, separators=(",", ":"))}')
        if attrs["directive_label"]:
            parts.append('"data":{"directiveLabel":true}')
        position = ""
        if attrs.get("start_line") is not None:
            a, b, c, d, e, f = (attrs[p] for p in PLACES)
            position = f',"position":{{"start":{{"line":{a},"column":{b},"offset":{c}}},"end":{{"line":{d},"column":{e},"offset":{f}}}}}'
        if kind in _CHILDLESS:
            self.out.append("{" + ",".join(parts) + position + "}")
            self.stack.append([level, None, 0])
        else:
            self.out.append("{" + ",".join(parts) + ',"children":[')
            self.stack.append([level, "]" + position + "}", 0])

    def _close(self, level: int) -> None:
        while self.stack and self.stack[-1][0] >= level:
            self.out.append(self.stack.pop()[1] or "")

    def end(self) -> str:
        self._close(-1)
        return "".join(self.out)
