"""A tree's rows as JSON and as HTML in the dialect of the unified ecosystem."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from .tree import Points, Row

# The attributes of each type in the order in which JSON has them, under their JSON names.
_JSON = {
    "heading": ("depth",), "list": ("ordered", "start", "spread"), "listItem": ("spread", "checked"), "code": ("lang", "meta", "value"),
    "html": ("value",), "text": ("value",), "inlineCode": ("value",), "yaml": ("value",), "toml": ("value",),
    "link": ("url", "title"), "image": ("url", "title", "alt"), "definition": ("identifier", "label", "url", "title"),
    "linkReference": ("identifier", "label", "reference_type"), "imageReference": ("identifier", "label", "reference_type", "alt"),
    "footnoteDefinition": ("identifier", "label"), "footnoteReference": ("identifier", "label"), "table": ("align",),
    "defListDescription": ("spread",), "textDirective": ("name", "attributes"), "leafDirective": ("name", "attributes"),
    "containerDirective": ("name", "attributes"),
}
_CHILDLESS = frozenset("thematicBreak code html text inlineCode break image imageReference definition yaml toml footnoteReference".split())
_EMPTY = frozenset("html definition yaml toml".split())
#: Nodes that are one element around their children.
_ELEMENTS = {"paragraph": "p", "emphasis": "em", "strong": "strong", "delete": "del", "defListTerm": "dt", "defListDescription": "dd"}
_UNSAFE = re.compile(r"%[0-9A-Za-z]{2}|[^!#-;=?-Z_a-z~]|[&']")
_LINE_EDGE = re.compile(r"[ \t]*(\r\n|\n|\r)[ \t]*")


def _kids(rows: list[Row]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in rows]
    for row in rows[1:]:
        kids[row.parent].append(row.id)
    return kids


def to_json(rows: list[Row], text: str | None = None) -> str:
    """The tree as JSON; with the source's ``text`` every node that has a place has a ``position``."""
    kids, points, out = _kids(rows), Points(text) if text is not None else None, []
    todo: list = [0]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        row = rows[item]
        parts = [f'"type":"{row.type}"']
        for name in _JSON.get(row.type, ()):
            value = row.attrs.get(name)
            if name == "attributes":
                value = dict(value)
            parts.append(f'"{"referenceType" if name == "reference_type" else name}":{json.dumps(value, ensure_ascii=False, separators=(",", ":"))}')
        if row.attrs.get("directive_label"):
            parts.append('"data":{"directiveLabel":true}')
        position = ""
        if points and row.span:
            (a, b, c), (d, e, f) = points(row.span[0]), points(row.span[1])
            position = f',"position":{{"start":{{"line":{a},"column":{b},"offset":{c}}},"end":{{"line":{d},"column":{e},"offset":{f}}}}}'
        head = "{" + ",".join(parts)
        if row.type in _CHILDLESS:
            out.append(head + position + "}")
            continue
        out.append(head + ',"children":[')
        todo.append("]" + position + "}")
        for k, kid in enumerate(reversed(kids[item])):
            if k:
                todo.append(",")
            todo.append(kid)
    return "".join(out)


def escape_text(text: str) -> str:
    return text.replace("&", "&#x26;").replace("<", "&#x3C;")


def escape_attribute(text: str) -> str:
    return text.replace("&", "&#x26;").replace('"', "&#x22;").replace("'", "&#x27;").replace("`", "&#x60;")


def _uri_char(m: re.Match) -> str:
    char = m[0]
    if len(char) > 1:
        return char
    if char in "&'":
        return "&#x26;" if char == "&" else "&#x27;"
    if char == "%":
        return char
    return "".join(f"%{b:02X}" for b in char.encode("utf-8", "surrogatepass"))


def escape_uri(url: str) -> str:
    return _UNSAFE.sub(_uri_char, url)


def trim_lines(text: str) -> str:
    """Blanks around inner line ends removed."""
    return _LINE_EDGE.sub(r"\1", text)


class UnifiedRenderer:
    """HTML of a tree: no raw HTML, no checkboxes, line ends between blocks only.

    ``element(type, attributes)`` may give a node another tag (None: its own) and further HTML attributes, as
    plug-ins do by ``hName`` and ``hProperties``; they win over the node's own. None or False as a value leaves an
    attribute out, True gives it no text. A node that has no element by itself (a directive) becomes one by its tag.
    """

    def __init__(self, element: Callable[[str, dict], tuple[str | None, dict] | None] | None = None):
        self.element = element

    def _tags(self, row: Row, tag: str | None, **own: str) -> tuple[str, str]:
        """A node's tags; the values of ``own`` are escaped already."""
        found = self.element(row.type, row.attrs) if self.element else None
        if found:
            tag = found[0] or tag
            for name, value in found[1].items():
                own.pop(name, None)
                if value is not None and value is not False:
                    own[name] = "" if value is True else escape_attribute(str(value))
        if tag is None:
            return "", ""
        return f"<{tag}" + "".join(f' {name}="{value}"' for name, value in own.items()) + ">", f"</{tag}>"

    def render(self, rows: list[Row]) -> str:
        self.rows, self.kids = rows, _kids(rows)
        self.targets: dict[str, Row] = {}
        for row in rows:
            if row.type == "definition":
                self.targets.setdefault(row.attrs["identifier"], row)
        out: list[str] = []
        todo: list = [0]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                todo.extend(reversed(self._pieces(rows[item])))
        return "".join(out)

    def _wrapped(self, numbers: list[int], loose: bool) -> list:
        shown = [n for n in numbers if self.rows[n].type not in _EMPTY]
        pieces: list = ["\n"] if loose else []
        for k, n in enumerate(shown):
            pieces += ["\n", n] if k else [n]
        return [*pieces, "\n"] if loose and shown else pieces

    def _item(self, row: Row, loose: bool) -> list:
        shown = [n for n in self.kids[row.id] if self.rows[n].type not in _EMPTY]
        opening, closing = self._tags(row, "li")
        pieces: list = [opening]
        for k, n in enumerate(shown):
            tight = self.rows[n].type == "paragraph" and not loose
            if k or not tight:
                pieces.append("\n")
            pieces += self.kids[n] if tight else [n]
        if shown and (loose or self.rows[shown[-1]].type != "paragraph"):
            pieces.append("\n")
        return [*pieces, closing]

    def _pieces(self, row: Row) -> list:
        kind, attrs, kids = row.type, row.attrs, self.kids[row.id]
        if kind == "root" or kind == "footnoteDefinition":
            return self._wrapped(kids, False)
        if kind == "text":
            return [escape_text(trim_lines(attrs["value"]))]
        if kind == "inlineCode":
            opening, closing = self._tags(row, "code")
            return [opening + escape_text(re.sub(chr(13) + "?" + chr(10) + "|" + chr(13), " ", attrs["value"])) + closing]
        if kind == "blockquote":
            opening, closing = self._tags(row, "blockquote")
            return [opening, *self._wrapped(kids, True), closing]
        if kind == "list":
            start = {"start": str(attrs["start"])} if attrs["ordered"] and attrs["start"] != 1 else {}
            opening, closing = self._tags(row, "ol" if attrs["ordered"] else "ul", **start)
            loose = attrs["spread"] or any(self.rows[n].attrs["spread"] for n in kids)
            pieces: list = [opening + "\n"]
            for k, n in enumerate(kids):
                pieces += (["\n"] if k else []) + self._item(self.rows[n], loose)
            return [*pieces, "\n" + closing]
        if kind == "code":
            words = (attrs["lang"] or "").split()
            opening, closing = self._tags(row, "code", **({"class": f"language-{escape_attribute(words[0])}"} if words else {}))
            return [f"<pre>{opening}{escape_text(attrs['value'])}" + ("\n" if attrs["value"] else "") + f"{closing}</pre>"]
        if kind == "thematicBreak":
            return [self._tags(row, "hr")[0]]
        if kind == "break":
            return [self._tags(row, "br")[0] + "\n"]
        if kind in _ELEMENTS or kind == "heading":
            label = attrs.get("directive_label")
            opening, closing = self._tags(row, None if label else _ELEMENTS.get(kind) or f"h{attrs['depth']}")
            return [opening, *kids, closing]
        if kind in ("link", "image"):
            return self._target(row, attrs["url"], attrs["title"])
        if kind in ("linkReference", "imageReference"):
            target = self.targets.get(attrs["identifier"])
            if target:
                return self._target(row, target.attrs["url"], target.attrs["title"])
            suffix = {"shortcut": "]", "collapsed": "][]"}.get(attrs["reference_type"], f"][{attrs['label'] or attrs['identifier']}]")
            return [escape_text(f"![{attrs['alt']}{suffix}")] if kind[0] == "i" else ["[", *kids, escape_text(suffix)]
        if kind == "defList":
            opening, closing = self._tags(row, "dl")
            return [opening + "\n", *(piece for n in kids for piece in (n, "\n")), closing]
        if kind == "table":
            return self._table(row)
        if kind in ("html", "definition", "yaml", "toml", "footnoteReference"):
            return []
        opening, closing = self._tags(row, None)
        return [opening, *kids, closing]

    def _target(self, row: Row, url: str, title: str | None) -> list:
        more = {} if title is None else {"title": escape_attribute(title)}
        if row.type.startswith("image"):
            return [self._tags(row, "img", src=escape_uri(url), alt=escape_attribute(row.attrs["alt"]), **more)[0]]
        opening, closing = self._tags(row, "a", href=escape_uri(url), **more)
        return [opening, *self.kids[row.id], closing]

    def _table(self, row: Row) -> list:
        """A table by the same line rules; its rows padded or cut to the head's width."""
        align = row.attrs["align"]
        opening, closing = self._tags(row, "table")
        pieces: list = [opening + "\n"]
        for k, number in enumerate(self.kids[row.id]):
            tag = "td" if k else "th"
            pieces.append({0: "<thead>\n", 1: "<tbody>\n"}.get(k, ""))
            tr = self._tags(self.rows[number], "tr")
            pieces.append(tr[0] + "\n")
            cells = self.kids[number]
            for j, a in enumerate(align):
                own = {"align": a} if a else {}
                first, last = self._tags(self.rows[cells[j]], tag, **own) if j < len(cells) else (f'<{tag} align="{a}">' if a else f"<{tag}>", f"</{tag}>")
                pieces.append(first)
                pieces += self.kids[cells[j]] if j < len(cells) else []
                pieces.append(last + "\n")
            pieces.append(tr[1] + "\n")
            if not k:
                pieces.append("</thead>\n")
        return [*pieces, f"</tbody>\n{closing}" if len(self.kids[row.id]) > 1 else closing]
