"""Documents that differ in their words alone are parsed once: their trees are one tree with other words in it.

A document's shape is its text with a letter of its own for each word. Words mean nothing to the syntax without extensions, but for numbers
before ``.`` or ``)`` (they stay) and names behind the characters of ``_TELLING`` (texts with one of these have no shape here). Where labels may
be defined, words that differ in no letter share theirs, so that labels are equal in the shape where they are in the text.

A list of bullets that ends a text has a shape for each item (``_items``): lists written from tables differ in how many lines each item has, so
that as a whole hardly two are of one shape, while their items are of a few.
"""

from __future__ import annotations

import re
from operator import itemgetter

_WORD = re.compile(r"([0-9]*[A-Za-z][A-Za-z0-9]*|[0-9]+(?![0-9.)]))")
#: HTML, autolinks, character references and escapes depend on words; columns behind a tab on their length.
_TELLING = re.compile(r"[<&@\\\t\r\0]")
#: Letters that stand for words: a text is ASCII, so they aren't in it.
_FIRST = 0x20000
_LETTERS = [chr(_FIRST + k) for k in range(1000)]
_LETTER = re.compile(f"([{_LETTERS[0]}-{_LETTERS[-1]}])")
#: Longest text that is looked up, and nodes (or 16 characters) that are kept of all shapes together: about 80 MB in a worker at most.
_LONGEST, _KEPT = 4_000, 250_000
#: Longest text with labels, in bytes: a longer label is none.
_LABELLED = 999
#: Ends of lines behind which neither an item begins, a bullet in the first column, nor a line that is indented below an item's text and not blank.
_OTHER = {c: re.compile(rf"\n(?!  +[^ \n]|[{c}] [^ \n])") for c in "-+*"}
_FIRST_ITEM = re.compile(r"(?:\A|(?<=\n\n))[-+*] [^ \n]")
#: What may let an item depend on the one before it: fences, and lines of marks alone (rules, underlines, empty items and quotes).
_BINDING = re.compile(r"```|~~~|^(?:[ >*+\-_#]|[0-9]+[.)])*$", re.M)
#: What a text may end with ahead of its list.
_CLOSED = frozenset(("paragraph", "heading", "thematicBreak"))
#: Columns of numbers of nodes, and those that are there even if all is null.
_MOVED = frozenset(("node_id", "parent_id", "subtree_end"))
_ALWAYS = frozenset(("node_id", "parent_id", "ordinal", "depth_in_tree", "subtree_end", "type"))


class Shape:
    """Columns of a tree's nodes, and in which strings of them which words belong."""

    def __init__(self, n_nodes: int, columns: dict[str, list]):
        self.n_nodes, self.columns = n_nodes, columns
        self.holes = {}
        for name, values in columns.items():
            found = [(k, *_hole(v)) for k, v in enumerate(values) if isinstance(v, str) and _LETTER.search(v)]
            if found:
                #: A value that is one word is taken from the words as it is.
                self.holes[name] = [(k, ord(values[k]) - _FIRST) for k, form, _ in found if form == "%s"], [h for h in found if h[1] != "%s"]

    def fill(self, words: list[str]) -> dict[str, list]:
        columns = dict(self.columns)
        for name, (plain, formed) in self.holes.items():
            values = columns[name] = columns[name].copy()
            told = [w.lower() for w in words] if name == "identifier" else words
            for k, nth in plain:
                values[k] = told[nth]
            for k, form, chosen in formed:
                values[k] = form % chosen(told)
        return columns


def _hole(value: str) -> tuple[str, itemgetter]:
    parts = _LETTER.split(value)
    return "%s".join(p.replace("%", "%%") for p in parts[::2]), itemgetter(*(ord(c) - _FIRST for c in parts[1::2]))


def _shared(words: list[str]) -> tuple[list[str], list[str]]:
    """A letter for each word, the same for the same word, and the words by their letters. A word in capitals here and not there stays: as a label it is one."""
    first, mixed = {}, set()
    for word in words:
        if first.setdefault(word.lower(), word) != word:
            mixed.add(word.lower())
    told = [w for k, w in first.items() if k not in mixed]
    letters = dict(zip(told, _LETTERS))
    return [letters.get(w, w) for w in words], told


def _items(text: str) -> tuple[str, list[str]] | None:
    """What stands ahead of a text's last list, and its items, if each can be parsed by itself."""
    first = _FIRST_ITEM.search(text)
    if first is None:
        return None
    at, body = first.start(), text.removesuffix("\n")
    bullet = body[at]
    if _OTHER[bullet].search(body, at) or _BINDING.search(body, at):
        return None
    begins = f"\n{bullet} "
    items = body[at:].split(begins)
    return (text[:at], [items[0], *[begins[1:] + item for item in items[1:]]]) if len(items) > 1 else None


class Piece(Shape):
    """The nodes of ``types`` of a part of a text, without the first ``around`` ones, from which its numbers count."""

    def __init__(self, columns: dict[str, list], types: frozenset[str] | None, around: int):
        kinds, levels = columns["type"], columns["depth_in_tree"]
        self.size, self.n_blocks = len(kinds) - around, levels.count(1)
        self.last = next((kind for kind, level in zip(kinds[::-1], levels[::-1]) if level == 1), None)
        rows = [k for k in range(around, len(kinds)) if types is None or kinds[k] in types]
        #: Where the root, the list and the item are among the rows.
        self.root, self.list, self.item = (rows.index(k) if k in rows else None for k in range(3))
        kept = {}
        for name, values in columns.items():
            values = [values[k] for k in rows]
            if name in _MOVED:
                kept[name] = [None if v is None else v - around for v in values]
            elif name in _ALWAYS or any(v is not None for v in values):
                kept[name] = values
        super().__init__(len(rows), kept)


class Shapes:
    """The shapes met so far; ``columns`` makes the columns of a text's nodes. What is kept is bounded: a full store starts anew.

    With ``whole``, which gives the columns of all nodes of a text, items of lists have shapes of their own; ``types`` are those that ``columns`` keeps.
    """

    def __init__(self, columns, whole=None, types: frozenset[str] | None = None):
        self.of, self.known, self.kept, self.whole, self.types = columns, {}, 0, whole, types

    def _keep(self, form: object, shape: Shape, length: int) -> None:
        if self.kept > _KEPT:
            self.known, self.kept = {}, 0
        self.known[form] = shape
        self.kept += shape.n_nodes + length // 16

    def _piece(self, text: str, around: int) -> tuple[Piece, list[str]]:
        parts = _WORD.split(text)
        words = parts[1::2]
        if len(words) > len(_LETTERS) or len(text) > _LONGEST:
            return Piece(self.whole(text), self.types, around), []
        parts[1::2] = _LETTERS[: len(words)]
        form = "".join(parts)
        piece = self.known.get((around, form))
        if piece is None:
            piece = Piece(self.whole(form), self.types, around)
            self._keep((around, form), piece, len(form))
        return piece, words

    def _listed(self, ahead: str, items: list[str]) -> dict[str, list] | None:
        """A text's columns from those of its parts, numbered on; None where a block ahead of the list might go on in it."""
        piece, words = self._piece(ahead, 0)
        if piece.size > 1 and piece.last not in _CLOSED:
            return None
        columns = {name: values.copy() for name, values in piece.fill(words).items()}
        ends = [] if piece.root is None else [0]
        number, nth_block, at, n = piece.size, piece.n_blocks, piece.size, piece.n_nodes
        for nth, item in enumerate(items):
            piece, words = self._piece(item, 2 if nth else 1)
            for name, values in piece.fill(words).items():
                mine = columns.get(name)
                if mine is None:
                    mine = columns[name] = []
                if len(mine) < n:
                    mine += [None] * (n - len(mine))
                mine += [v + at for v in values] if name in _MOVED else values
            if piece.item is not None:
                columns["parent_id"][n + piece.item], columns["ordinal"][n + piece.item] = number, nth
            if piece.list is not None:
                columns["parent_id"][n], columns["ordinal"][n] = 0, nth_block
                ends.append(n)
            at += piece.size
            n += piece.n_nodes
        for k in ends:
            columns["subtree_end"][k] = at - 1
        for values in columns.values():
            values += [None] * (n - len(values))
        return columns

    def columns(self, text: str) -> dict[str, list]:
        if not text.isascii() or _TELLING.search(text):
            return self.of(text)
        parts = _items(text) if self.whole and "]:" not in text else None
        columns = self._listed(*parts) if parts else None
        if columns is not None:
            return columns
        if len(text) > _LONGEST:
            return self.of(text)
        parts = _WORD.split(text)
        words = parts[1::2]
        if len(words) > len(_LETTERS):
            return self.of(text)
        if "]:" in text:
            parts[1::2], words = _shared(words)
            form = "".join(parts)
            if len(text) > _LABELLED or len(form.encode()) > _LABELLED:
                return self.of(text)
        else:
            parts[1::2] = _LETTERS[: len(words)]
            form = "".join(parts)
        shape = self.known.get(form)
        if shape is None:
            columns = self.of(form)
            shape = Shape(len(columns["node_id"]), columns)
            self._keep(form, shape, len(form))
        return shape.fill(words)
