"""Characters, references and escapes that blocks and inlines share."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from html.entities import html5

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NAMED = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]*));")
_ESCAPE_OR_REFERENCE = re.compile(r"\\([!-/:-@\[-`{-~])|" + REFERENCE.pattern)
_SPACES = re.compile(r"[ \t\n\r\f\v\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _code_point(number: int) -> str:
    if 0x80 <= number <= 0x9F:  # the C1 range stands for windows-1252, as browsers read it
        try:
            return bytes([number]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(number)
    if number == 0 or number > 0x10FFFF or 0xD800 <= number <= 0xDFFF:
        return "\ufffd"
    return chr(number)


def reference(match: re.Match) -> str:
    """The characters of a reference; an unknown name stays as it is."""
    hexadecimal, decimal, name = match.group(1, 2, 3)
    if hexadecimal:
        return _code_point(int(hexadecimal, 16))
    if decimal:
        return _code_point(int(decimal))
    return _NAMED.get(name, match[0])


def decode_references(text: str) -> str:
    """All references of a text resolved."""
    return REFERENCE.sub(reference, text) if "&" in text else text


def _unescaped(match: re.Match) -> str:
    if match[1]:
        return match[1]
    if match[2]:
        return _code_point(int(match[2], 16))
    if match[3]:
        return _code_point(int(match[3]))
    return _NAMED.get(match[4], match[0])


def unescape(text: str) -> str:
    """Backslash escapes and references resolved (destinations, titles, labels, info strings)."""
    return _ESCAPE_OR_REFERENCE.sub(_unescaped, text) if "\\" in text or "&" in text else text


def is_space(char: str) -> bool:
    """Unicode White_Space ('' is a text's edge and counts)."""
    return not char or _SPACES.match(char) is not None


def is_punctuation(char: str) -> bool:
    """ASCII punctuation, or beyond ASCII what is neither white space nor alphanumeric."""
    if not char:
        return False
    if char < "\x80":
        return char in PUNCTUATION
    return not is_alphanumeric(char) and not is_space(char)


def is_alphanumeric(char: str) -> bool:
    """Letters, numbers and the combining marks that belong to words."""
    return char.isalnum() or unicodedata.category(char) in ("Mc", "Nl", "No") or char == "\u0345"


def lower_each(text: str) -> str:
    """Lower case character by character (no rule for a word's last sigma)."""
    return text.lower() if text.isascii() else "".join(c.lower() for c in text)


@lru_cache(4096)
def label_key(label: str) -> str:
    """What two reference labels are compared by."""
    joined = _SPACES.sub(" ", label).strip(" ")
    return lower_each(joined).replace("ß", "ss")


def escape(text: str) -> str:
    """``& < > "`` as named references, for text and attributes."""
    if "&" in text:
        text = text.replace("&", "&amp;")
    if "<" in text:
        text = text.replace("<", "&lt;")
    if ">" in text:
        text = text.replace(">", "&gt;")
    return text.replace('"', "&quot;") if '"' in text else text


_UNSAFE_URL = re.compile(r"[^A-Za-z0-9\-_.+!*(),%#@?=;:/$~]")


def _url_char(match: re.Match) -> str:
    char = match[0]
    if char == "&":
        return "&amp;"
    if char == "'":
        return "&#x27;"
    return "".join(f"%{b:02X}" for b in char.encode("utf-8", "surrogatepass"))


def escape_href(url: str) -> str:
    """A destination as an attribute: unsafe bytes percent-encoded, existing escapes kept."""
    return _UNSAFE_URL.sub(_url_char, url)
