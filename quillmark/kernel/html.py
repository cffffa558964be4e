"""HTML in the dialect of CommonMark's reference output."""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..options import Options
from .blocks import Block, BlockParser, split_cells
from .chars import escape, escape_href, is_alphanumeric, lower_each
from .emoji import SHORTCODES
from .inline import InlineParser, Node

#: Elements whose start tags the tag filter disarms.
FILTERED_TAGS = "title textarea style xmp iframe noembed noframes script plaintext".split()
_FILTERED = re.compile(r"<(?=(?:" + "|".join(FILTERED_TAGS) + r")(?:[ \t\n\r\f/>]|$))", re.I)
_EXTERNAL = re.compile(r"(<a href=\"https?://[^\"]*\"(?:[^\">]|\"[^\"]*\")*)>")
_TAG = re.compile(r"<[^>]*>?")
_BLANK_LINES = re.compile(r"\n(?:[ \t]*\n)+")
_PLAIN_BREAK = re.compile(r" ?\n[ \t]*")
TASK = re.compile(r"\[([ xX])\](?=[ \t\n]|$)")


def filter_tags(html: str) -> str:
    return _FILTERED.sub("&lt;", html)


def external_links(html: str) -> str:
    """``rel="nofollow"`` on every link to an http(s) address, raw HTML included."""
    return _EXTERNAL.sub(r'\1 rel="nofollow">', html)


def slug(inline_html: str) -> str:
    """A heading's id before repeats are told apart, from its rendered text."""
    text = _TAG.sub("", inline_html)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = text.replace(name, char)
    return "".join("-" if c == " " else c if c in "-_" else lower_each(c) if is_alphanumeric(c) else "" for c in text)


def encode_id(identifier: str) -> str:
    """An identifier as part of a URL."""
    from urllib.parse import quote

    return quote(identifier, safe="-_.!~*'()")


def marked_pattern(options: Options) -> re.Pattern:
    """Finds what may make a document more than paragraphs of plain text."""
    inline = r"\\`*_\[\]!<&" + ("~" if options.strikethrough else "")
    if options.autolink or options.emoji or options.directives or options.deflist or options.tables:
        inline += ":"
    if options.autolink:
        inline += "@"
    if options.tables:
        inline += "|"
    words = r"|[wW]{3}\." if options.autolink else ""
    return re.compile(rf"^[ \t]*[#>~+\-=0-9]|^(?: {{4}}| {{0,3}}\t)|  $|[{inline}]{words}", re.M)


def plain_html(text: str) -> str:
    """A document of plain paragraphs."""
    out = []
    for part in _BLANK_LINES.split(text):
        part = part.strip(" \t\n")
        if part:
            out.append(f"<p>{escape(_PLAIN_BREAK.sub(chr(10), part))}</p>\n")
    return "".join(out)


class HtmlRenderer:
    """Renders parsed documents; one object serves many documents."""

    def __init__(self, options: Options | None = None, emoji: dict[str, str] | None = None):
        self.options = options or Options()
        self.emoji = SHORTCODES if emoji is None else emoji
        self._marked = marked_pattern(self.options)

    def render(self, text: str) -> str:
        if not text:
            return ""
        if not self.options.hard_wraps and not self._marked.search(text):
            return plain_html(text)
        parser = BlockParser(text, self.options)
        self.inline = InlineParser(self.options, parser.references, parser.footnotes, self.emoji)
        self.out: list[str] = []
        self.slugs: dict[str, int] = {}
        self.order: list[str] = []
        self.seen: dict[str, int] = {}
        self._blocks(parser.root.kids)
        if self.order:
            self._notes(parser.root)
        html = "".join(self.out)
        return external_links(html) if self.options.external_links else html

    def _cr(self) -> None:
        out = self.out
        if out and out[-1][-1] != "\n":
            out.append("\n")

    def _put(self, piece: str) -> None:
        if piece:
            self.out.append(piece)

    # Blocks: a stack of blocks to render and of strings to write after them ("\0" stands for a line end).

    def _blocks(self, blocks: Iterable[Block]) -> None:
        todo: list = list(reversed(list(blocks)))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                if item == "\0":
                    self._cr()
                else:
                    self.out.append(item)
                continue
            after = self._block(item)
            if after is not None:
                todo.extend(reversed(after))
                todo.extend(reversed(item.kids))

    def _block(self, b: Block) -> list[str] | None:
        """Render a leaf or a container's opening; for a container what follows its children."""
        kind, put = b.kind, self._put
        if kind == "paragraph":
            item = b.parent
            text, box = b.text, ""
            if item.kind == "listItem" and self.options.tasklist and item.kids[0] is b:
                m = TASK.match(text)
                if m:
                    box = f'<input {"" if m[1] == " " else "checked=\"\" "}disabled="" type="checkbox">'
                    text = text[3:]
            if item.kind == "listItem" and item.parent.data["tight"]:
                put(box)
                put(self._inlines(text))
            else:
                self._cr()
                put("<p>" + box)
                put(self._inlines(text))
                put("</p>\n")
        elif kind == "heading":
            self._cr()
            body, name = self._inlines(b.text), f"h{b.data['depth']}"
            mark = f' id="{self._heading_id(body)}"' if self.options.heading_ids else ""
            put(f"<{name}{mark}>{body}</{name}>\n")
        elif kind == "blockquote":
            self._cr()
            put("<blockquote>\n")
            return ["\0", "</blockquote>\n"]
        elif kind == "list":
            self._cr()
            tag = "ol" if b.data["ordered"] else "ul"
            start = f' start="{b.data["start"]}"' if b.data["ordered"] and b.data["start"] != 1 else ""
            put(f"<{tag}{start}>\n")
            return ["\0", f"</{tag}>\n"]
        elif kind == "listItem":
            self._cr()
            put("<li>")
            return ["</li>\n"]
        elif kind in ("fence", "indented"):
            self._cr()
            words = b.data.get("info", "").split() if kind == "fence" else ()
            if words and words[0] == "mermaid" and self.options.diagram:
                put(f'<pre class="mermaid">{escape(b.text)}</pre>\n')
            else:
                language = f' class="language-{escape(words[0])}"' if words else ""
                put(f"<pre><code{language}>{escape(b.text)}</code></pre>\n")
        elif kind == "html":
            self._cr()
            put(filter_tags(b.text) if self.options.tagfilter else b.text)
            self._cr()
        elif kind == "thematicBreak":
            self._cr()
            put("<hr />\n")
        elif kind == "table":
            self._table(b)
        elif kind == "defList":
            self._cr()
            put("<dl>\n")
            return ["\0", "</dl>\n"]
        elif kind == "defListTerm":
            self._cr()
            for line in b.text.split("\n"):
                put(f"<dt>{self._inlines(line)}</dt>\n")
        elif kind == "defListDescription":
            self._cr()
            body = self._inlines(b.text)
            put(f"<dd>\n<p>{body}</p>\n</dd>\n" if b.data["spread"] else f"<dd>{body}\n</dd>\n")
        elif kind == "leafDirective":
            self._cr()
            put(self._element(b.data["name"], b.data["attributes"]))
            put(self._inlines(b.data["label"][0]) if "label" in b.data else "")
            put(f"</{b.data['name']}>\n")
        elif kind == "containerDirective":
            self._cr()
            put(self._element(b.data["name"], b.data["attributes"]) + "\n")
            if "label" in b.data:
                put(f"<p>{self._inlines(b.data['label'][0])}</p>\n")
            return ["\0", f"</{b.data['name']}>\n"]
        return None

    @staticmethod
    def _element(name: str, attributes: list[tuple[str, str]]) -> str:
        return f"<{name}" + "".join(f' {escape(k)}="{escape(v)}"' for k, v in attributes) + ">"

    def _heading_id(self, body: str) -> str:
        base = slug(body)
        if base in self.slugs:
            self.slugs[base] += 1
            return f"{base}-{self.slugs[base]}"
        self.slugs[base] = 0
        return base

    def _table(self, b: Block) -> None:
        self._cr()
        align = b.data["align"]

        def row(line: str, tag: str) -> str:
            cells = [line[lo:hi].strip().replace("\\|", "|") for lo, hi in split_cells(line)]
            cells = (cells + [""] * len(align))[: len(align)]
            marks = [f' align="{a}"' if a else "" for a in align]
            return "<tr>\n" + "".join(f"<{tag}{m}>{self._inlines(c)}</{tag}>\n" for m, c in zip(marks, cells)) + "</tr>\n"

        lines = [piece for _, piece in b.data["rows"]]
        out = "<table>\n<thead>\n" + row(lines[0], "th") + "</thead>\n"
        body = "".join(row(line, "td") for line in lines[2:])
        self._put(out + (f"<tbody>\n{body}</tbody>\n" if body else "") + "</table>\n")

    # Footnotes.

    def _notes(self, root: Block) -> None:
        """The section of notes in the order of their first references."""
        first: dict[str, Block] = {}
        todo = [root]
        while todo:
            b = todo.pop()
            if b.kind == "footnoteDefinition":
                first.setdefault(b.data["identifier"], b)
            todo.extend(reversed(b.kids))
        self._cr()
        self._put('<section data-footnotes class="footnotes"><h2 class="sr-only" id="footnote-label">Footnotes</h2>\n<ol>\n')
        for number, identifier in enumerate(list(self.order), 1):
            safe, count = encode_id(identifier), self.seen[identifier]
            self._put(f'<li id="user-content-fn-{safe}">\n')
            kids = first[identifier].kids
            refs = []
            for k in range(1, count + 1):
                again = f"-{k}" if k > 1 else ""
                label = f"<sup>{k}</sup>" if k > 1 else ""
                refs.append(f'<a href="#user-content-fnref-{safe}{again}" data-footnote-backref="" aria-label="Back to reference {number}{again}" class="data-footnote-backref">↩{label}</a>')
            for k, block in enumerate(kids):
                last = k == len(kids) - 1
                if last and block.kind == "paragraph":
                    self._cr()
                    self._put(f"<p>{self._inlines(block.text)} {' '.join(refs)}</p>\n")
                    continue
                self._blocks([block])
                if last:
                    self._cr()
                    self._put("".join(r + "\n" for r in refs))
            self._put("</li>\n")
        self._put("</ol>\n</section>")

    def _reference(self, identifier: str) -> str:
        if identifier not in self.seen:
            self.order.append(identifier)
        self.seen[identifier] = count = self.seen.get(identifier, 0) + 1
        safe, again = encode_id(identifier), f"-{count}" if count > 1 else ""
        return (f'<sup><a href="#user-content-fn-{safe}" id="user-content-fnref-{safe}{again}" data-footnote-ref '
                f'aria-describedby="footnote-label">{self.order.index(identifier) + 1}</a></sup>')

    # Inlines.

    def _inlines(self, text: str) -> str:
        if self.inline.plain(text):
            return escape(text.rstrip(" \t\n"))
        return self.markup(self.inline.parse(text.rstrip(" \t\n")))

    def markup(self, nodes: list[Node]) -> str:
        out: list[str] = []
        todo: list = list(reversed(nodes))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
                continue
            kind = n.type
            if kind == "text":
                out.append(escape(n.value))
            elif kind == "break":
                out.append("<br />\n")
            elif kind == "inlineCode":
                out.append(f"<code>{escape(n.value)}</code>")
            elif kind == "html":
                out.append(filter_tags(n.value) if self.options.tagfilter else n.value)
            elif kind in ("emphasis", "strong", "delete"):
                tag = {"emphasis": "em", "strong": "strong", "delete": "del"}[kind]
                out.append(f"<{tag}>")
                todo.append(f"</{tag}>")
                todo.extend(reversed(n.kids))
            elif kind in ("link", "linkReference"):
                title = n.extra["title"]
                out.append(f'<a href="{escape_href(n.extra["url"])}"' + (f' title="{escape(title)}"' if title else "") + ">")
                todo.append("</a>")
                todo.extend(reversed(n.kids))
            elif kind in ("image", "imageReference"):
                title = n.extra["title"]
                out.append(f'<img src="{escape_href(n.extra["url"])}" alt="{self._alt(n.kids)}"' + (f' title="{escape(title)}"' if title else "") + " />")
            elif kind == "footnoteReference":
                out.append(self._reference(n.extra["identifier"]))
            elif kind == "textDirective":
                out.append(self._element(n.extra["name"], n.extra["attributes"]))
                todo.append(f"</{n.extra['name']}>")
                todo.extend(reversed(n.kids))
        return "".join(out)

    @staticmethod
    def _alt(nodes: list[Node]) -> str:
        out, todo = [], list(reversed(nodes))
        while todo:
            n = todo.pop()
            if n.type in ("text", "inlineCode"):
                out.append(escape(n.value))
            elif n.type == "break":
                out.append("\n")
            elif n.kids:
                todo.extend(reversed(n.kids))
        return "".join(out)
