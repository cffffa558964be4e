"""Block structure: a fold over a document's lines.

Each line first continues the open blocks it may continue, then opens new ones, and what is left is
added as text. Leaves keep their lines with their places in the source, so that inlines can be placed.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from ..options import Options
from .chars import label_key, unescape
from .directive import parse_header

# Names that begin an HTML block which a blank line ends.
HTML_BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param section summary table tbody td tfoot th thead title tr track ul"
).split()

_ATTR = r"(?:[ \t\n]+[A-Za-z_:][A-Za-z0-9_.:-]*(?:[ \t\n]*=[ \t\n]*(?:[^ \t\n\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
OPEN_TAG = r"<[A-Za-z][A-Za-z0-9-]*" + _ATTR + r"*[ \t\n]*/?>"
CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*[ \t\n]*>"
_HTML_STARTS = (
    (1, re.compile(r"<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I)),
    (2, re.compile(r"<!--")),
    (3, re.compile(r"<\?")),
    (4, re.compile(r"<![A-Za-z]")),
    (5, re.compile(r"<!\[CDATA\[")),
    (6, re.compile(r"</?(?:" + "|".join(HTML_BLOCK_NAMES) + r")(?:[ \t]|/?>|$)", re.I)),
    (7, re.compile(r"(?!<(?:script|pre|style|textarea)\b)(?:" + OPEN_TAG + "|" + CLOSE_TAG + r")[ \t]*$")),
)
_HTML_ENDS = {1: re.compile(r"</(?:script|pre|style|textarea)>", re.I), 2: re.compile("-->"), 3: re.compile(r"\?>"), 4: re.compile(">"), 5: re.compile(r"\]\]>")}
_ATX = re.compile(r"#{1,6}(?=[ \t]|$)")
_ATX_CLOSE = re.compile(r"(?:^|(?<=[ \t]))#+[ \t]*$")
_SETEXT = re.compile(r"(?:=+|-+)[ \t]*$")
_RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:_[ \t]*){3,}$|(?:-[ \t]*){3,}$")
_FENCE = re.compile(r"`{3,}(?=[^`]*$)|~{3,}")
_BULLET = re.compile(r"[*+-]")
_ORDERED = re.compile(r"(\d{1,9})([.)])", re.A)
_FOOTNOTE = re.compile(r"\[\^((?:\\.|[^\[\] \t\r\n\\]|\\(?=\]))+)\]:")
_MAY_START = re.compile(r"[#>`~*+\-_=<0-9]")
_LABEL = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]:?", re.S)
_TITLE = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)", re.S)
_ANGLE = re.compile(r"<((?:\\[^\n]|[^<>\n\\])*)>")
_PLAIN = re.compile(r"(?:\\[!-/:-@\[-`{-~]|[^\\()\x00-\x20\x7f]|\\)+")
_BLANKS = re.compile(" *")
_GAP = re.compile(r"[ \t]*(?:\n[ \t]*)?")
_FRONT = {"---": "yaml", "+++": "toml"}

CONTAINERS = frozenset(("document", "blockquote", "listItem", "footnoteDefinition", "containerDirective"))
LINE_LEAVES = frozenset(("paragraph", "fence", "indented", "html", "table", "defListDescription"))


class Block:
    """A block: its kind, its place, and for leaves the lines of its text with their offsets."""

    __slots__ = ("kind", "parent", "kids", "open", "beg", "end", "lines", "text", "segments", "blank_last", "data")

    def __init__(self, kind: str, parent: Block | None, beg: int, end: int):
        self.kind, self.parent, self.beg, self.end = kind, parent, beg, end
        self.kids: list[Block] = []
        self.lines: list[tuple[int, str]] = []
        self.open, self.blank_last = True, False
        self.text, self.segments = "", None
        self.data: dict = {}


def join_lines(lines: list[tuple[int, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The lines as one text, and (text offset, source offset) where each begins."""
    at, segments = 0, []
    for source, piece in lines:
        segments.append((at, source))
        at += len(piece) + 1
    return "\n".join(piece for _, piece in lines), segments


def cut_front(text: str, segments: list[tuple[int, int]], n: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without its first ``n`` characters."""
    out = []
    for k, (at, source) in enumerate(segments):
        following = segments[k + 1][0] if k + 1 < len(segments) else len(text) + 1
        if following > n:
            out.append((max(0, at - n), source + max(0, n - at)))
    return text[n:], out


def link_destination(text: str, pos: int) -> tuple[int, str] | None:
    """A destination at ``pos``: where it ends, and its raw text."""
    m = _ANGLE.match(text, pos)
    if m:
        return m.end(), m[1]
    if text[pos : pos + 1] == "<":
        return None
    depth, at = 0, pos
    while True:
        m = _PLAIN.match(text, at)
        if m:
            at = m.end()
        char = text[at : at + 1]
        if char == "(":
            depth += 1
            if depth > 32:
                return None
        elif char == ")" and depth:
            depth -= 1
        else:
            return (at, text[pos:at]) if not depth else None
        at += 1


def link_title(text: str, pos: int) -> tuple[int, str] | None:
    m = _TITLE.match(text, pos)
    return (m.end(), m[0][1:-1]) if m else None


def read_label(text: str, pos: int) -> re.Match | None:
    """A bracketed label at ``pos`` of at most 999 bytes; its colon, if one follows, included."""
    m = _LABEL.match(text, pos)
    return m if m and len(m[1].encode("utf-8", "surrogatepass")) <= 999 else None


def reference_definition(text: str, start: int = 0) -> tuple[int, int, str, str, str | None] | None:
    """A link reference definition at ``start``.

    Where its line ends (with the newline), where the definition ends, its raw label, destination and title.
    """
    lead = _BLANKS.match(text, start).end()
    if text[lead : lead + 1] != "[":
        return None
    label = read_label(text, lead)
    if not label or not label[0].endswith("]:") or not label[1].strip():
        return None
    pos = _GAP.match(text, label.end()).end()
    target = link_destination(text, pos)
    if not target or target[0] == pos:
        return None
    end, url = target
    gap = _GAP.match(text, end).end()
    title = link_title(text, gap) if gap > end else None
    if title:
        rest = text.find("\n", title[0])
        rest = len(text) if rest < 0 else rest
        if not text[title[0] : rest].strip(" \t"):
            return min(len(text), rest + 1), rest, label[1], url, title[1]
    rest = text.find("\n", end)
    rest = len(text) if rest < 0 else rest
    if text[end:rest].strip(" \t"):
        return None
    return min(len(text), rest + 1), rest, label[1], url, None


def split_cells(line: str) -> list[tuple[int, int]]:
    """The cells of a table row, as spans of the line (a pipe after a backslash divides nothing)."""
    lo, hi = len(line) - len(line.lstrip(" \t")), len(line.rstrip(" \t"))
    cuts = [m.start() for m in re.finditer(r"\\.|\|", line[:hi], re.S) if m[0] == "|" and m.start() >= lo]
    edges = [lo - 1, *cuts, hi]
    spans = [(a + 1, b) for a, b in zip(edges, edges[1:])]
    if spans and spans[0][0] == spans[0][1]:
        spans.pop(0)
    if len(spans) > 1 and spans[-1][0] == spans[-1][1]:
        spans.pop()
    return spans


def delimiter_row(line: str) -> list[str | None] | None:
    """Alignments, if the line divides a table's head from its body."""
    row = line.strip(" \t")
    if not re.fullmatch(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?", row) or not ("|" in row or ":" in row):
        return None
    cells = [c.strip(" \t") for c in row.removeprefix("|").removesuffix("|").split("|")]
    return [{(True, True): "center", (True, False): "left", (False, True): "right", (False, False): None}[c[0] == ":", c[-1] == ":"] for c in cells]


class BlockParser:
    """Parses one document; ``root``, ``references`` and ``footnotes`` are the results."""

    def __init__(self, text: str, options: Options):
        self.source, self.options = text, options
        self.root = self.tip = Block("document", None, 0, len(text))
        self.references: dict[str, tuple[str, str | None]] = {}
        self.footnotes: set[str] = set()
        self.prev_blank = False
        starts = "#>`~*+-_=<0123456789"
        if options.tables:
            starts += "|:"
        if options.footnotes:
            starts += "["
        if options.deflist or options.directives:
            starts += ":"
        self.starts = frozenset(starts)
        self._run()

    # The cursor: index, column, and columns left of a tab that is partly used.

    def _load(self, line: str, base: int) -> None:
        self.line, self.base, self.at, self.column, self.tab, self.next = line, base, 0, 0, 0, -1
        self.last_matched: Block | None = None

    def _look(self) -> None:
        """Find the next character that is no blank (it stays the next one while the cursor is not beyond it)."""
        line = self.line
        n = len(line)
        if self.at > self.next:
            at, column = self.at, self.column + self.tab
            while at < n:
                char = line[at]
                if char == " ":
                    column += 1
                elif char == "\t":
                    column += 4 - column % 4
                else:
                    break
                at += 1
            self.next, self.next_column = at, column
        self.blank = self.next >= n
        self.indent = self.next_column - self.column

    def _skip(self) -> None:
        self.at, self.column, self.tab = self.next, self.next_column, 0

    def _advance(self, columns: int) -> None:
        """Use up columns of blanks; a tab may be used in part."""
        while columns > 0:
            if self.tab:
                used = min(self.tab, columns)
                self.tab -= used
                self.column += used
                columns -= used
                continue
            if self.at >= len(self.line):
                return
            char = self.line[self.at]
            self.at += 1
            if char == "\t":
                self.tab = 4 - self.column % 4
            else:
                self.column += 1
                columns -= 1

    def _take(self, n: int) -> None:
        """Pass over ``n`` characters that are no tabs."""
        self.at += n
        self.column += n
        self.tab = 0

    def _blank_here(self) -> bool:
        return self.tab > 0 or self.line[self.at : self.at + 1] in (" ", "\t") and self.at < len(self.line)

    # Tree building.

    def _add(self, kind: str, beg: int) -> Block:
        while not self._holds(self.tip.kind, kind):
            self._close(self.tip)
        block = Block(kind, self.tip, beg, self.base + len(self.line))
        self.tip.kids.append(block)
        self.tip = block
        return block

    @staticmethod
    def _holds(parent: str, kind: str) -> bool:
        if parent in CONTAINERS:
            return kind != "listItem"
        if parent == "list":
            return kind == "listItem"
        return parent == "defList" and kind in ("defListTerm", "defListDescription", "paragraph")

    def _close_unmatched(self) -> None:
        while self.tip is not self.last_matched:
            self._close(self.tip)

    def _run(self) -> None:
        source, pos = self.source, 0
        if self.options.frontmatter:
            pos = self._frontmatter()
        size = len(source)
        while pos < size:
            end = source.find("\n", pos)
            if end < 0:
                end = size
            self._line(source[pos:end], pos)
            pos = end + 1
        while self.tip is not None:
            tip = self.tip
            self._close(tip)
            self.tip = tip.parent

    def _frontmatter(self) -> int:
        source = self.source
        marker = source[:3]
        if marker not in _FRONT:
            return 0
        m = re.compile(r"(?:\A|(?<=\n))" + re.escape(marker) + r"[ \t]*\r?(?:\n|\Z)")
        first = m.match(source)
        last = m.search(source, first.end()) if first and source[first.end() - 1 : first.end()] == "\n" else None
        if not last:
            return 0
        value = source[first.end() : last.start()]
        value = value[:-1] if value.endswith("\n") else value
        value = value[:-1] if value.endswith("\r") else value
        fence_end = last.start() + len(last[0].rstrip("\r\n"))
        block = Block(_FRONT[marker], self.root, 0, fence_end)
        block.text, block.open = value, False
        self.root.kids.append(block)
        return last.end()

    def _line(self, line: str, base: int) -> None:
        self._load(line, base)
        container = self.root
        while container.kids and container.kids[-1].open:
            child = container.kids[-1]
            self._look()
            verdict = self._continues(child)
            if verdict == 2:
                self.prev_blank = False
                return
            if verdict == 1:
                break
            container = child
        self.last_matched = container
        old_tip, verdict = self.tip, 0
        while container.kind not in LINE_LEAVES or container.kind in ("paragraph", "table"):
            self._look()
            if self.blank or (self.indent < 4 and line[self.next] not in self.starts):
                break
            verdict = self._start(container)
            if not verdict:
                break
            container = self.last_matched = self.tip
            if verdict == 2:
                break
        self._look()
        if verdict == 2:  # what a leaf's own mark uses up leaves no blank line
            self.blank = False
        if self.tip is old_tip and self.tip is not self.last_matched and not self.blank and self.tip.kind == "paragraph":
            self._text()
        else:
            if self.tip is old_tip:
                self._close_unmatched()
            self._finish(container)
        self.prev_blank = self.blank if self.tip.kind not in ("fence", "html") else False

    def _finish(self, container: Block) -> None:
        if self.blank and container.kids:
            container.kids[-1].blank_last = True
        kind = container.kind
        quiet = kind in ("blockquote", "fence") or (kind == "listItem" and not container.kids and container.data["line"] == self.base)
        mark, up = self.blank and not quiet, container
        while up is not None:
            up.blank_last = mark
            up = up.parent
        if kind in LINE_LEAVES:
            if kind == "paragraph" and self.blank:
                return
            self._text()
            if kind == "html" and container.data["type"] <= 5 and _HTML_ENDS[container.data["type"]].search(self.line, self.at):
                container.end = self.base + len(self.line)
                self._close(container)
        elif not self.blank and kind not in ("heading", "thematicBreak", "leafDirective") and self.at < len(self.line):
            self._skip()
            self._add("paragraph", self.base + self.at)
            self._text()

    def _text(self) -> None:
        """Add the rest of the line to the tip."""
        tip = self.tip
        if tip.kind in ("paragraph", "table", "defListDescription"):
            self._look()
            self._skip()
        pad = " " * self.tab
        tip.lines.append((self.base + self.at - (1 if pad else 0), pad + self.line[self.at :]))
        tip.end = self.base + len(self.line)

    # Phase one: does a block go on?  0 yes, 1 no, 2 yes and the line is used up.

    def _continues(self, block: Block) -> int:
        kind = block.kind
        if kind in ("list", "defList"):
            return 0
        if kind == "paragraph" or kind == "table":
            return int(self.blank)
        if kind == "blockquote":
            if self.indent < 4 and not self.blank and self.line[self.next] == ">":
                block.end = max(block.end, self.base + len(self.line))
                self._skip()
                self._take(1)
                if self._blank_here():
                    self._advance(1)
                return 0
            return 1
        if kind == "listItem":
            width = block.data["indent"] + block.data["padding"]
            if self.blank:
                if not block.kids:
                    return 1
                self._skip()
                return 0
            if self.indent >= width:
                self._advance(width)
                return 0
            return 1
        if kind == "footnoteDefinition":
            if self.blank:
                if not block.kids:
                    return 1
                self._skip()
                return 0
            if self.indent >= 4:
                self._advance(4)
                return 0
            return 1
        if kind == "fence":
            data = block.data
            if self.indent < 4 and not self.blank and self.line[self.next] == data["char"]:
                m = re.match(re.escape(data["char"]) + r"{%d,}[ \t]*$" % data["size"], self.line[self.next :])
                if m:
                    data["closed"] = True
                    block.end = self.base + len(self.line)
                    self.last_matched = block
                    self._close_deeper(block)
                    return 2
            left = data["offset"]
            while left > 0 and self._blank_here():
                self._advance(1)
                left -= 1
            return 0
        if kind == "indented":
            if self.indent >= 4:
                self._advance(4)
                return 0
            if self.blank:
                self._skip()
                return 0
            return 1
        if kind == "html":
            return int(self.blank and block.data["type"] >= 6)
        if kind == "defListDescription":
            return int(self.blank or self._def_marker())
        if kind == "containerDirective":
            if self.indent < 4 and not self.blank and self.line[self.next] == ":":
                run = self.line[self.next :].rstrip(" \t\r")
                if run.strip(":") == "" and len(run) >= max(3, block.data["size"]):
                    block.end = self.base + len(self.line)
                    block.data["closed"] = True
                    self._close_deeper(block)
                    return 2
            return 0
        return 1

    def _close_deeper(self, block: Block) -> None:
        while self.tip is not block:
            self._close(self.tip)
        self._close(block)

    # Phase two: what may a line open?  0 nothing, 1 a container, 2 a leaf.

    def _start(self, container: Block) -> int:
        line, at = self.line, self.next
        if self.indent >= 4:
            if self.tip.kind != "paragraph" and container.kind != "table" and not self.blank:
                self._advance(4)
                self._close_unmatched()
                self._add("indented", self.base + self.at)
                self.tip.data["beg"] = self.base
                return 2
            return 0
        char, rest, options = line[at], line[at:], self.options
        if char == ">":
            self._skip()
            self._take(1)
            if self._blank_here():
                self._advance(1)
            self._close_unmatched()
            self._add("blockquote", self.base + at)
            return 1
        if char == "#":
            m = _ATX.match(rest)
            if m:
                self._close_unmatched()
                block = self._add("heading", self.base + at)
                body = rest[m.end() :].rstrip(" \t")
                body = _ATX_CLOSE.sub("", body).rstrip(" \t")
                lead = len(body) - len(body.lstrip(" \t"))
                block.data["depth"] = m.end()
                block.text, block.segments = body[lead:], [(0, self.base + at + m.end() + lead)]
                self.at = len(line)
                return 2
        if char in "`~":
            m = _FENCE.match(rest)
            if m:
                self._close_unmatched()
                block = self._add("fence", self.base + at)
                block.data.update(char=char, size=m.end(), offset=self.indent, closed=False)
                self._skip()
                self._take(m.end())
                return 2
        if char == "<":
            for number, start in _HTML_STARTS:
                if start.match(rest) and (number < 7 or (container.kind != "paragraph" and not (self.tip is not self.last_matched and self.tip.kind == "paragraph"))):
                    self._close_unmatched()
                    block = self._add("html", self.base + self.at)
                    block.data["type"] = number
                    return 2
        if container.kind == "paragraph" and char in "=-" and _SETEXT.match(rest):
            self._close_unmatched()
            self._peel(container)
            if container.text:
                container.kind = "heading"
                container.data["depth"] = 1 if char == "=" else 2
                container.end = self.base + len(line)
                container.text, container.segments = self._trimmed(container)
                container.lines = []
                self.tip = container
                self.at = len(line)
                return 2
        if char in "*-_" and _RULE.match(rest):
            self._close_unmatched()
            self._add("thematicBreak", self.base + at)
            self.at = len(line)
            return 2
        if (char in "*+-" or char.isdigit()) and (self.tip.kind != "fence"):
            if self._list_item(container):
                return 1
        if char == "[" and options.footnotes:
            m = _FOOTNOTE.match(rest)
            if m:
                self._close_unmatched()
                block = self._add("footnoteDefinition", self.base + at)
                block.data.update(label=m[1], identifier=m[1].lower())
                self.footnotes.add(m[1].lower())
                self._skip()
                self._take(m.end())
                if self._blank_here():
                    self._advance(1)
                return 1
        if char == ":":
            if options.deflist and self._def_marker():
                verdict = self._description(container)
                if verdict:
                    return verdict
            if options.directives:
                verdict = self._directive()
                if verdict:
                    return verdict
        if options.tables and container.kind == "paragraph" and len(container.lines) == 1 and char in "|:-":
            align = delimiter_row(rest)
            if align and len(split_cells(container.lines[0][1])) == len(align):
                self._close_unmatched()
                container.kind = "table"
                container.data["align"] = align
                self.tip = container
                self._skip()
                return 2
        return 0

    def _def_marker(self) -> bool:
        return self.indent < 4 and not self.blank and self.line[self.next] == ":" and self.line[self.next + 1 : self.next + 2] in (" ", "\t") and self.next + 1 < len(self.line)

    def _list_item(self, container: Block) -> bool:
        line, at, indent = self.line, self.next, self.indent
        m = _BULLET.match(line, at)
        if m:
            data = {"ordered": False, "bullet": m[0], "start": None, "delimiter": None}
        else:
            m = _ORDERED.match(line, at)
            if not m or (container.kind == "paragraph" and int(m[1]) != 1):
                return False
            data = {"ordered": True, "bullet": None, "start": int(m[1]), "delimiter": m[2]}
        if line[m.end() : m.end() + 1] not in ("", " ", "\t"):
            return False
        if container.kind == "paragraph" and not line[m.end() :].strip(" \t"):
            return False
        beg = self.base + at
        self._skip()
        self._take(m.end() - at)
        here = (self.at, self.column, self.tab)
        while True:
            self._advance(1)
            if self.column - here[1] >= 5 or not self._blank_here():
                break
        blank_item = self.at >= len(line) and not self.tab or not line[self.at :].strip(" \t")
        width = self.column - here[1] if self._moved(here) else 0
        if width >= 5 or width < 1 or blank_item:
            data["padding"] = m.end() - at + 1
            self.at, self.column, self.tab = here
            if self._blank_here():
                self._advance(1)
        else:
            data["padding"] = m.end() - at + width
        data.update(indent=indent, line=self.base)
        self._close_unmatched()
        if self.tip.kind != "list" or any(self.tip.data[k] != data[k] for k in ("ordered", "bullet", "delimiter")):
            self._add("list", beg).data.update(data)
        self._add("listItem", beg).data.update(data)
        return True

    def _moved(self, here: tuple[int, int, int]) -> bool:
        return self.column > here[1]

    def _description(self, container: Block) -> int:
        loose = self.prev_blank
        if container.kind == "paragraph":
            term = container
        elif container.kind == "defList":
            term = None
            self._close_unmatched()
            last = container.kids[-1] if container.kids else None
            if last is not None and last.kind == "paragraph":
                last.kind, last.open = "defListTerm", False
            self.tip = container
        else:
            term = container.kids[-1] if container.kids else None
            if term is None or term.kind != "paragraph":
                return 0
        if term is not None:
            if term.open:
                self._seal(term)
            if not term.text:
                return 0
            term.kind, term.open = "defListTerm", False
            parent = term.parent
            if parent.kind != "defList":
                new = Block("defList", parent, term.beg, term.end)
                parent.kids[parent.kids.index(term)] = new
                new.kids.append(term)
                term.parent = parent = new
            self.tip = self.last_matched = parent
        block = self._add("defListDescription", self.base + self.next)
        block.data["spread"] = loose
        self._skip()
        self._take(1)
        if self._blank_here():
            self._advance(1)
        return 2

    def _directive(self) -> int:
        rest = self.line[self.next :]
        colons = len(rest) - len(rest.lstrip(":"))
        header = parse_header(rest, colons) if colons >= 2 else None
        if not header or rest[colons + header.size :].strip(" \t\r"):
            return 0
        beg = self.base + self.next
        self._close_unmatched()
        block = self._add("leafDirective" if colons == 2 else "containerDirective", beg)
        block.data.update(name=header.name, attributes=header.attributes, size=colons, closed=False)
        if header.label:
            lo, hi = header.label
            block.data["label"] = (rest[lo:hi], beg + lo)
        self.at, self.tab = len(self.line), 0
        return 2 if colons == 2 else 1

    # Closing.

    def _trimmed(self, block: Block) -> tuple[str, list]:
        text, segments = block.text, block.segments
        lead = len(text) - len(text.lstrip(" \t\n"))
        if lead:
            text, segments = cut_front(text, segments, lead)
        return text.rstrip(" \t\n"), segments

    def _peel(self, block: Block) -> None:
        """Take reference definitions off a paragraph's head; they become its elder siblings."""
        text, segments = join_lines(block.lines)
        found, at = [], 0
        while (definition := reference_definition(text, at)):
            after, end, label, url, title = definition
            key = label_key(label)
            start = _place(segments, _BLANKS.match(text, at).end())
            node = Block("definition", block.parent, start, _place(segments, end - 1) + 1)
            node.open = False
            node.data.update(label=label, identifier=key, url=unescape(url), title=None if title is None else unescape(title))
            found.append(node)
            self.references.setdefault(key, (node.data["url"], node.data["title"]))
            at = after
        if found:
            siblings = block.parent.kids
            k = len(siblings) - 1 - siblings[::-1].index(block)
            siblings[k:k] = found
            text, segments = cut_front(text, segments, at)
        block.text, block.segments = text, segments
        if segments:
            block.beg = segments[0][1]

    def _seal(self, block: Block) -> None:
        """Turn a paragraph's lines into text, without definitions; an empty one goes."""
        self._peel(block)
        block.lines = []
        block.text, block.segments = self._trimmed(block)
        if not block.text:
            block.parent.kids.remove(block)

    def _close(self, block: Block) -> None:
        block.open = False
        kind = block.kind
        if kind == "paragraph":
            self._seal(block)
        elif kind == "fence":
            lines = block.lines
            info = lines[0][1] if lines else ""
            block.data["info"] = unescape(info.strip(" \t"))
            block.text = "".join(piece + "\n" for _, piece in lines[1:])
            block.lines = []
        elif kind == "indented":
            lines = block.lines
            while lines and not lines[-1][1].strip(" \t"):
                lines.pop()
            block.text = "".join(piece + "\n" for _, piece in lines)
            if lines:
                block.end = lines[-1][0] + len(lines[-1][1].lstrip("\x00"))
                block.end = self._line_end(lines[-1][0])
            block.lines = []
        elif kind == "html":
            while len(block.lines) > 1 and not block.lines[-1][1].strip(" "):
                block.lines.pop()
            block.text, block.segments = join_lines(block.lines)
            if block.lines:
                block.end = self._line_end(block.lines[-1][0])
            block.lines = []
        elif kind == "table":
            block.data["rows"] = block.lines
            block.lines = []
        elif kind == "defListDescription":
            block.text, block.segments = join_lines(block.lines)
            block.text, block.segments = self._trimmed(block)
            block.lines = []
        elif kind == "list":
            self._spacing(block)
        elif kind == "defList":
            last = block.kids[-1] if block.kids else None
            if last is not None and last.kind == "paragraph":
                block.kids.pop()
                siblings = block.parent.kids
                siblings.insert(siblings.index(block) + 1, last)
                last.parent = block.parent
        if kind in ("list", "listItem", "defList", "footnoteDefinition") and block.kids:
            block.end = block.kids[-1].end if kind != "footnoteDefinition" else max(block.end if not block.kids else 0, block.kids[-1].end)
        elif kind == "blockquote" and block.kids:
            block.end = max(block.end, block.kids[-1].end)
        elif kind == "containerDirective" and not block.data["closed"] and block.kids:
            block.end = max(block.end, block.kids[-1].end)
        if self.tip is block and block.parent is not None:
            self.tip = block.parent

    def _line_end(self, offset: int) -> int:
        end = self.source.find("\n", offset)
        return len(self.source) if end < 0 else end

    @staticmethod
    def _ends_blank(block: Block) -> bool:
        while True:
            if block.blank_last:
                return True
            if block.kind in ("list", "listItem") and block.kids:
                block = block.kids[-1]
            else:
                return False

    def _spacing(self, block: Block) -> None:
        """Whether blank lines stand between a list's items, or between an item's children."""
        items = block.kids
        block.data["spread"] = any(self._ends_blank(i) for i in items[:-1])
        for item in items:
            item.data["spread"] = any(self._ends_blank(k) for k in item.kids[:-1])
        block.data["tight"] = not (block.data["spread"] or any(i.data["spread"] for i in items))


def _place(segments: list[tuple[int, int]], offset: int) -> int:
    """The source offset of a text offset."""
    at, source = segments[max(0, bisect_right(segments, offset, key=lambda s: s[0]) - 1)]
    return source + offset - at
