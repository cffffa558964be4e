"""Inline structure of one leaf's text: a linked list of nodes, delimiters and brackets."""

from __future__ import annotations

import re

from ..options import Options
from . import autolink
from .blocks import CLOSE_TAG, OPEN_TAG, link_destination, link_title, read_label
from .chars import PUNCTUATION, REFERENCE, is_punctuation, is_space, label_key, reference, unescape
from .directive import parse_header

_HTML = re.compile(
    OPEN_TAG + "|" + CLOSE_TAG + r"|<!---?>|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>"
)
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*)>")
_MAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
_TICKS = re.compile(r"`+")
_SPNL = re.compile(r"[ \t]*\n?[ \t]*")
_EMOJI = re.compile(r":([-+\w]+):", re.A)
_FOOTNOTE = re.compile(r"\[\^((?:\\.|[^\[\] \t\r\n\\])+)\]", re.S)


class Node:
    """An inline node; ``kids`` are set for nodes that hold others, ``extra`` has a node's attributes."""

    __slots__ = ("type", "beg", "end", "value", "kids", "extra", "prev", "next")

    def __init__(self, kind: str, beg: int, end: int, value: str = ""):
        self.type, self.beg, self.end, self.value = kind, beg, end, value
        self.kids: list[Node] | None = None
        self.extra: dict | None = None
        self.prev: Node | None = None
        self.next: Node | None = None


class _Mark:
    __slots__ = ("char", "node", "count", "size", "opens", "closes")

    def __init__(self, char, node, count, opens, closes):
        self.char, self.node, self.count, self.size, self.opens, self.closes = char, node, count, count, opens, closes


class _Bracket:
    __slots__ = ("node", "image", "active", "floor", "after")

    def __init__(self, node, image, floor, after):
        self.node, self.image, self.active, self.floor, self.after = node, image, True, floor, after


class InlineParser:
    """Parses texts of one document. ``tree``: for the tree, where code keeps its line ends."""

    def __init__(self, options: Options, references: dict, footnotes: set[str], emoji: dict[str, str], tree: bool = False):
        self.options, self.references, self.footnotes, self.emoji, self.tree = options, references, footnotes, emoji, tree
        specials = r"\\\n`*_\[\]!<&"
        if options.strikethrough:
            specials += "~"
        if options.autolink or options.emoji or options.directives:
            specials += ":"
        if options.autolink:
            specials += "@"
        pattern = f"[{specials}]" + (r"|[wW]{3}\." if options.autolink else "")
        self._special = re.compile(pattern)

    def plain(self, text: str) -> bool:
        """Whether a text is a single text node as it stands."""
        return not self._special.search(text)

    def parse(self, text: str) -> list[Node]:
        head = Node("head", 0, 0)
        self.text, self.last = text, head
        self.marks: list[_Mark] = []
        self.brackets: list[_Bracket] = []
        self.no_ticks: dict[int, bool] = {}
        special, size, pos, run = self._special, len(text), 0, 0
        handlers = {"\\": self._backslash, "`": self._code, "*": self._delimiter, "_": self._delimiter, "~": self._delimiter,
                    "!": self._bang, "[": self._open, "]": self._close, "<": self._angle, "&": self._reference,
                    ":": self._colon, "@": self._at, "w": self._www, "W": self._www, "\n": self._break}
        while pos < size:
            m = special.search(text, pos)
            if not m:
                break
            at = m.start()
            after = handlers[text[at]](at, run)
            if after is None:
                pos = at + 1
            else:
                pos = run = after
        if run < size:
            self._push(Node("text", run, size, text[run:]))
        self._emphasis(0)
        return self._collect(head)

    # The list.

    def _push(self, node: Node) -> Node:
        node.prev, self.last.next = self.last, node
        self.last = node
        return node

    def _flush(self, run: int, at: int) -> None:
        if at > run:
            self._push(Node("text", run, at, self.text[run:at]))

    def _unlink(self, node: Node) -> None:
        node.prev.next = node.next
        if node.next is not None:
            node.next.prev = node.prev
        else:
            self.last = node.prev

    def _collect(self, head: Node, stop: Node | None = None) -> list[Node]:
        """The nodes after ``head`` up to ``stop``, neighbouring texts joined."""
        out: list[Node] = []
        node = head.next
        while node is not stop and node is not None:
            if node.type == "text":
                if out and out[-1].type == "text":
                    out[-1].value += node.value
                    out[-1].end = node.end
                elif node.value:
                    out.append(node)
            else:
                out.append(node)
            node = node.next
        return out

    def _enclose(self, kind: str, before: Node, after: Node | None, beg: int, end: int) -> Node:
        """A node in place of all between ``before`` and ``after``, with these as its children."""
        node = Node(kind, beg, end)
        node.kids = self._collect(before, after)
        node.prev, node.next = before, after
        before.next = node
        if after is not None:
            after.prev = node
        else:
            self.last = node
        return node

    # Handlers: where the scan goes on and the text so far has been pushed, or None for a literal.

    def _backslash(self, at: int, run: int) -> int | None:
        char = self.text[at + 1 : at + 2]
        if char == "\n":
            self._flush(run, at)
            self._push(Node("break", at, at + 2))
            return at + 2
        if char and char in PUNCTUATION:
            self._flush(run, at)
            self._push(Node("text", at, at + 2, char))
            return at + 2
        return None

    def _reference(self, at: int, run: int) -> int | None:
        m = REFERENCE.match(self.text, at)
        if not m:
            return None
        value = reference(m)
        if value == m[0]:
            return None
        self._flush(run, at)
        self._push(Node("text", at, m.end(), value))
        return m.end()

    def _break(self, at: int, run: int) -> int | None:
        text = self.text
        end = at
        while end > run and text[end - 1] == " ":
            end -= 1
        hard = at - end >= 2 and not (self.tree and end > run and text[end - 1] == "\t")
        if self.tree:
            while end > run and text[end - 1] in " \t":
                end -= 1
        self._flush(run, end)
        if hard:
            self._push(Node("break", end, at + 1))
        elif self.options.hard_wraps:
            self._push(Node("break", at, at + 1))
        else:
            self._push(Node("text", at, at + 1, "\n"))
        return at + 1

    def _code(self, at: int, run: int) -> int:
        text = self.text
        ticks = _TICKS.match(text, at)
        size, pos = len(ticks[0]), ticks.end()
        if not self.no_ticks.get(size):
            while m := _TICKS.search(text, pos):
                pos = m.end()
                if len(m[0]) == size:
                    self._flush(run, at)
                    raw = text[ticks.end() : m.start()]
                    value = raw if self.tree else raw.replace("\n", " ")
                    pads = " \n" if self.tree else " "
                    if len(value) > 1 and value[0] in pads and value[-1] in pads and value.strip(" \n"):
                        value = value[1:-1]
                    self._push(Node("inlineCode", at, pos, value))
                    return pos
            self.no_ticks[size] = True  # no run of this length follows, for any later opener either
        self._flush(run, ticks.end())
        return ticks.end()

    def _angle(self, at: int, run: int) -> int | None:
        for pattern, prefix in ((_URI, ""), (_MAIL, "mailto:")):
            m = pattern.match(self.text, at)
            if m:
                self._flush(run, at)
                node = self._push(Node("link", at, m.end()))
                node.kids = [Node("text", at + 1, m.end() - 1, m[1])]
                node.extra = {"url": prefix + m[1], "title": None}
                return m.end()
        m = _HTML.match(self.text, at)
        if not m:
            return None
        self._flush(run, at)
        self._push(Node("html", at, m.end(), m[0]))
        return m.end()

    def _delimiter(self, at: int, run: int) -> int | None:
        text, char = self.text, self.text[at]
        if char == "_" and self.options.autolink and autolink.in_mail(text, at, run):
            return None
        end = at
        while text[end : end + 1] == char:
            end += 1
        count = end - at
        before, after = text[at - 1 : at] if at else "", text[end : end + 1]
        space_before, space_after = is_space(before), is_space(after)
        punct_before, punct_after = is_punctuation(before), is_punctuation(after)
        left = not space_after and (not punct_after or space_before or punct_before)
        right = not space_before and (not punct_before or space_after or punct_after)
        opens, closes = left, right
        if char == "_":
            opens, closes = left and (not right or punct_before), right and (not left or punct_after)
        self._flush(run, at)
        node = self._push(Node("text", at, end, text[at:end]))
        if (opens or closes) and not (char == "~" and count > 2):
            self.marks.append(_Mark(char, node, count, opens, closes))
        return end

    def _bang(self, at: int, run: int) -> int | None:
        if self.text[at + 1 : at + 2] != "[":
            return None
        self._flush(run, at)
        node = self._push(Node("text", at, at + 2, "!["))
        self.brackets.append(_Bracket(node, True, len(self.marks), at + 2))
        return at + 2

    def _open(self, at: int, run: int) -> int:
        self._flush(run, at)
        if self.options.footnotes:
            m = _FOOTNOTE.match(self.text, at)
            if m and m[1].lower() in self.footnotes:
                node = self._push(Node("footnoteReference", at, m.end()))
                node.extra = {"identifier": m[1].lower(), "label": m[1]}
                return m.end()
        node = self._push(Node("text", at, at + 1, "["))
        self.brackets.append(_Bracket(node, False, len(self.marks), at + 1))
        return at + 1

    def _close(self, at: int, run: int) -> int | None:
        if not self.brackets:
            return None
        opener = self.brackets[-1]
        if not opener.active:
            self.brackets.pop()
            return None
        target = self._target(opener, at)
        if target is None:
            self.brackets.pop()
            return None
        self._flush(run, at)
        end, extra = target
        self._emphasis(opener.floor)
        self.brackets.pop()
        reference = "identifier" in extra
        kind = ("imageReference" if reference else "image") if opener.image else ("linkReference" if reference else "link")
        before = opener.node.prev
        self._unlink(opener.node)
        node = self._enclose(kind, before, None, opener.node.beg, end)
        node.extra = extra
        if not opener.image:
            for b in self.brackets:
                if not b.image:
                    b.active = False
        return end

    def _target(self, opener: _Bracket, at: int) -> tuple[int, dict] | None:
        text = self.text
        following = text[at + 1 : at + 2]
        if following == "(":
            found = self._inline_target(at + 2)
            if found:
                return found
        label, kind, end = text[opener.after : at], "shortcut", at + 1
        if following == "[":
            m = read_label(text, at + 1)
            if not m:
                return None
            full = m[1]
            end = at + 1 + len(full) + 2
            if full.strip():
                label, kind = full, "full"
            elif full:
                return None
            else:
                kind = "collapsed"
        if kind != "full" and (not label.strip() or len(label.encode("utf-8", "surrogatepass")) > 999 or re.search(r"(?<!\\)(?:\\\\)*\[", label)):
            return None
        key = label_key(label)
        if key not in self.references:
            return None
        url, title = self.references[key]
        return end, {"url": url, "title": title, "identifier": key, "label": label, "kind": kind}

    def _inline_target(self, pos: int) -> tuple[int, dict] | None:
        text = self.text
        pos = _SPNL.match(text, pos).end()
        found = link_destination(text, pos)
        if not found:
            return None
        end, url = found
        gap = _SPNL.match(text, end).end()
        title = link_title(text, gap) if gap > end else None
        if title:
            gap = _SPNL.match(text, title[0]).end()
        if text[gap : gap + 1] != ")":
            return None
        return gap + 1, {"url": unescape(url), "title": unescape(title[1]) if title else None}

    def _literal(self, beg: int, end: int, url: str, run: int) -> int:
        self._flush(run, beg)
        node = self._push(Node("link", beg, end))
        node.kids = [Node("text", beg, end, self.text[beg:end])]
        node.extra = {"url": url, "title": None}
        return end

    def _www(self, at: int, run: int) -> int | None:
        end = None if self.brackets else autolink.www(self.text, at)
        return None if end is None else self._literal(at, end, autolink.target(self.text[at:end]), run)

    def _at(self, at: int, run: int) -> int | None:
        span = None if self.brackets else autolink.mail(self.text, at, run)
        return None if span is None else self._literal(*span, "mailto:" + self.text[slice(*span)], run)

    def _colon(self, at: int, run: int) -> int | None:
        text, options = self.text, self.options
        if options.autolink and not self.brackets:
            span = autolink.url(text, at, run)
            if span:
                return self._literal(*span, text[slice(*span)], run)
        if options.emoji:
            m = _EMOJI.match(text, at)
            if m and m[1] in self.emoji:
                self._flush(run, at)
                self._push(Node("text", at, m.end(), self.emoji[m[1]]))
                return m.end()
        if options.directives and text[at - 1 : at] != ":":
            header = parse_header(text, at + 1)
            if header and text[at + 1 + header.size : at + 2 + header.size] != ":":
                end = at + 1 + header.size
                self._flush(run, at)
                node = self._push(Node("textDirective", at, end))
                node.extra = {"name": header.name, "attributes": header.attributes}
                node.kids = []
                if header.label:
                    lo, hi = header.label
                    inner = InlineParser(options, self.references, self.footnotes, self.emoji, self.tree)
                    node.kids = inner.parse(text[lo:hi])
                    shift(node.kids, lo)
                return end
        return None

    # Emphasis.

    def _emphasis(self, floor: int) -> None:
        marks, bottom = self.marks, {}
        i = floor
        while i < len(marks):
            closer = marks[i]
            if not closer.closes:
                i += 1
                continue
            key = (closer.char, closer.opens, closer.size % 3)
            j, low = i - 1, bottom.get(key, floor)
            while j >= low:
                opener = marks[j]
                if opener.char == closer.char and opener.opens:
                    if closer.char == "~":
                        if opener.count == closer.count:
                            break
                    elif not ((closer.opens or opener.closes) and closer.size % 3 and (opener.size + closer.size) % 3 == 0):
                        break
                j -= 1
            if j < low:
                bottom[key] = i
                if closer.opens:
                    i += 1
                else:
                    del marks[i]
                continue
            opener = marks[j]
            if closer.char == "~":
                used, kind = closer.count, "delete"
            else:
                used = 2 if opener.count >= 2 and closer.count >= 2 else 1
                kind = "strong" if used == 2 else "emphasis"
            del marks[j + 1 : i]
            i = j + 1
            bottom = {k: min(v, i) for k, v in bottom.items()}
            for mark in (opener, closer):
                mark.count -= used
                mark.node.value = mark.node.value[used:]
            opener.node.end -= used
            closer.node.beg += used
            self._enclose(kind, opener.node, closer.node, opener.node.end, closer.node.beg)
            if not closer.count:
                self._unlink(closer.node)
                del marks[i]
            if not opener.count:
                self._unlink(opener.node)
                del marks[j]
                i = j
                bottom = {k: min(v, i) for k, v in bottom.items()}
        del marks[floor:]


def shift(nodes: list[Node], by: int) -> None:
    """Move the places of nodes and all below them."""
    todo = list(nodes)
    while todo:
        node = todo.pop()
        node.beg += by
        node.end += by
        if node.kids:
            todo.extend(node.kids)


def plain_text(nodes: list[Node]) -> str:
    """What an image's alternative text keeps of its content."""
    out, todo = [], list(reversed(nodes))
    while todo:
        node = todo.pop()
        if node.type in ("text", "inlineCode"):
            out.append(node.value)
        elif node.type == "break":
            out.append("\n")
        elif node.kids:
            todo.extend(reversed(node.kids))
    return "".join(out)
