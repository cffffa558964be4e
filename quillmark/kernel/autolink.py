"""Literal autolinks: web and mail addresses that stand in plain text."""

from __future__ import annotations

import re

from .chars import is_punctuation, is_space

_TRAIL = frozenset("!\"'),*.:;?_~")
_ENTITY = re.compile(r"&[A-Za-z]+;")
_WWW = re.compile(r"[wW]{3}\.")
_SCHEME = re.compile(r"https?$", re.I)
_MAIL_DOMAIN = re.compile(r"(?:[A-Za-z0-9_-]|\.(?=[A-Za-z0-9]))+", re.A)
_LOCAL = re.compile(r"[A-Za-z0-9+\-._]+$", re.A)
_FORWARD_LOCAL = re.compile(r"[A-Za-z0-9+\-._]*@", re.A)
_DOMAIN_RUN = re.compile(r"[A-Za-z0-9-]+")
_PATH_RUN = re.compile(r"[A-Za-z0-9/=#%+$@^|\\{}`>-]+")
#: Where a second pass over a tree's text looks for addresses.
_LATE_URL = re.compile(r"(https?://|www(?=\.))([-.\w]+)([^ \t\r\n]*)", re.I | re.A)
_LATE_MAIL = re.compile(r"([-.\w+]+)@([-\w]+(?:\.[-\w]+)+)", re.A)


def _ends(text: str, at: int) -> bool:
    return at >= len(text) or is_space(text[at])


def _only_trail(text: str, at: int) -> bool:
    """Whether nothing but closing punctuation and references follows up to the address's end."""
    size = len(text)
    while at < size:
        char = text[at]
        if char in _TRAIL:
            at += 1
        elif char == "&":
            m = _ENTITY.match(text, at)
            if not m:
                return False
            at = m.end()
        elif char == "]":
            at += 1
            if at >= size or text[at] in "([" or is_space(text[at]):
                return True
        else:
            return char == "<" or is_space(char)
    return True


def _domain(text: str, at: int) -> int | None:
    """The domain's end; none if it is empty or one of its last two parts has an underscore."""
    start, labels = at, [False]
    seen = False
    while True:
        m = _DOMAIN_RUN.match(text, at)
        if m:
            seen, at = True, m.end()
        if at >= len(text):
            break
        char = text[at]
        if char in "._":
            if _only_trail(text, at):
                break
            if char == ".":
                labels.append(False)
            else:
                labels[-1] = True
            at += 1
        elif is_space(char) or is_punctuation(char):
            break
        else:
            seen, at = True, at + 1
    del start
    return at if seen and not any(labels[-2:]) else None


def _path(text: str, at: int) -> int:
    """The path's end: closing punctuation is left out, but for brackets the path has opened."""
    opened = closed = 0
    while True:
        m = _PATH_RUN.match(text, at)
        if m:
            at = m.end()
        if at >= len(text):
            return at
        char = text[at]
        if char == "(":
            opened += 1
        elif char == ")" and closed < opened:
            closed += 1
        elif char in _TRAIL or char in "&<]":
            if _only_trail(text, at):
                return at
            closed += char == ")"
        elif is_space(char):
            return at
        at += 1


def www(text: str, at: int) -> int | None:
    """The end of an address that begins with ``www.`` at ``at``."""
    if not _WWW.match(text, at) or at + 4 >= len(text) or (at and text[at - 1] not in " \t\n\r(*_[]~"):
        return None
    end = _domain(text, at)
    return None if end is None else _path(text, end)


def url(text: str, colon: int, low: int) -> tuple[int, int] | None:
    """The span of an http(s) address whose ``://`` is at ``colon``; it can't begin before ``low``."""
    if text[colon + 1 : colon + 3] != "//":
        return None
    m = _SCHEME.search(text, max(0, colon - 5), colon)
    if not m or m.start() < low or (m.start() and text[m.start() - 1].isascii() and text[m.start() - 1].isalpha()):
        return None
    first = text[colon + 3 : colon + 4]
    if not first or first < " " or "\x7f" <= first <= "\x9f" or is_space(first) or is_punctuation(first):
        return None
    end = _domain(text, colon + 3)
    return None if end is None else (m.start(), _path(text, end))


def mail(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The span of a mail address around the ``@`` at ``at``."""
    local = _LOCAL.search(text, low, at)
    if not local or (local.start() and (text[local.start() - 1] == "/" or re.match(r"[A-Za-z0-9+\-._]", text[local.start() - 1]))):
        return None
    m = _MAIL_DOMAIN.match(text, at + 1)
    if not m or "." not in m[0].lstrip(".") or not m[0][-1].isascii() or not m[0][-1].isalpha():
        return None
    return local.start(), m.end()


def in_mail(text: str, at: int, low: int) -> bool:
    """Whether the underscore at ``at`` is in the local part of an address."""
    m = _FORWARD_LOCAL.match(text, at)
    span = mail(text, m.end() - 1, low) if m else None
    return span is not None and span[0] <= at


def target(address: str) -> str:
    return address if re.match("https?://", address, re.I) else "http://" + address


def _late_url(m: re.Match, text: str) -> tuple[int, str] | None:
    before = text[m.start() - 1 : m.start()] if m.start() else ""
    if before and not (is_space(before) or is_punctuation(before)):
        return None
    protocol, domain, path = m[1], m[2], m[3]
    if protocol.lower().startswith("w"):
        domain, protocol, prefix = protocol + domain, "", "http://"
    else:
        prefix = ""
    parts = domain.split(".")
    if len(parts) < 2 or any(p and ("_" in p or not re.search(r"[A-Za-z0-9]", p)) for p in parts[-2:]):
        return None
    whole = domain + path
    trail = re.search(r"[!\"&'),.:;<>?\]}]+$", whole)
    if trail:
        tail, whole = trail[0], whole[: trail.start()]
        close = tail.find(")")
        while close >= 0 and whole.count("(") > whole.count(")"):
            whole, tail = whole + tail[: close + 1], tail[close + 1 :]
            close = tail.find(")")
    return (len(protocol + whole), prefix + protocol + whole) if whole else None


def _late_mail(m: re.Match, text: str) -> tuple[int, str] | None:
    before = text[m.start() - 1 : m.start()] if m.start() else ""
    if before == "/" or (before and not (is_space(before) or is_punctuation(before))):
        return None
    return None if re.search(r"[-\d_]$", m[2]) else (len(m[0]), "mailto:" + m[0])


def late(text: str) -> list[tuple[str, str | None]]:
    """Text cut into plain pieces and addresses: (piece, destination or None)."""
    def cut(pieces, pattern, judge):
        out = []
        for piece, dest in pieces:
            if dest is not None:
                out.append((piece, dest))
                continue
            at = 0
            pos = 0
            while m := pattern.search(piece, pos):
                found = judge(m, piece)
                if not found:
                    pos = m.start() + 1
                    continue
                if m.start() > at:
                    out.append((piece[at : m.start()], None))
                at = pos = m.start() + found[0]
                out.append((piece[m.start() : at], found[1]))
            if at < len(piece):
                out.append((piece[at:], None))
        return out

    return cut(cut([(text, None)], _LATE_URL, _late_url), _LATE_MAIL, _late_mail)
