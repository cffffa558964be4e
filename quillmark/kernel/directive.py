"""Directive headers: ``name[label]{attributes}``."""

from __future__ import annotations

import re
from typing import NamedTuple

_NAME = re.compile(r"[A-Za-z0-9_-]+")
_BRACKETS = re.compile(r"\\.|[\[\]]", re.S)
_BRACES = re.compile(r"\"[^\"]*\"|'[^']*'|[\"'}]")
_ATTRIBUTE = re.compile(r"#(?P<id>\S*)|\.(?P<cls>\S*)|(?P<key>[^\s=]+)(?:=(?:\"(?P<dq>[^\"]*)\"?|'(?P<sq>[^']*)'?|(?P<bare>\S*)))?|.", re.S | re.A)


class Header(NamedTuple):
    name: str
    label: tuple[int, int] | None
    attributes: list[tuple[str, str]]
    size: int


def _closing(source: str, start: int) -> int:
    """Where the bracket that opens at ``start`` closes, or -1."""
    depth = 0
    for m in _BRACKETS.finditer(source, start):
        if m[0] == "[":
            depth += 1
        elif m[0] == "]":
            depth -= 1
            if not depth:
                return m.start()
    return -1


def attributes(source: str) -> list[tuple[str, str]]:
    """Pairs in order of first appearance: classes add up, otherwise the last value holds."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        if m["id"] is not None:
            found["id"] = m["id"]
        elif m["cls"] is not None:
            found["class"] = f"{found['class']} {m['cls']}" if "class" in found else m["cls"]
        elif m["key"]:
            value = next((v for v in m.group("dq", "sq", "bare") if v is not None), "")
            if m["key"] == "class" and "class" in found:
                value = f"{found['class']} {value}"
            found[m["key"]] = value
    return list(found.items())


def parse_header(source: str, start: int = 0) -> Header | None:
    """The header that begins at ``start`` (just after the colons), its size counted from there."""
    m = _NAME.match(source, start)
    if not m:
        return None
    end, label, pairs = m.end(), None, []
    if source[end : end + 1] == "[":
        close = _closing(source, end)
        if close >= 0:
            label, end = (end + 1, close), close + 1
    if source[end : end + 1] == "{":
        for b in _BRACES.finditer(source, end + 1):
            if b[0] == "}":
                pairs, end = attributes(source[end + 1 : b.start()]), b.end()
                break
            if len(b[0]) == 1:  # a quotation without an end
                break
    return Header(m[0], label, pairs, end - start)
