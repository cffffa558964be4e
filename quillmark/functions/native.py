"""Functions that are Catalyst expressions: they stay in generated code and reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel.html import FILTERED_TAGS

_TAGS = r"(?i)<(?=(?:" + "|".join(FILTERED_TAGS) + r")(?:[ \t\n\r\f/>]|$))"
_EXTERNAL = r'(<a href="https?://[^"]*"(?:[^">]|"[^"]*")*)>'
# What may begin a block or end a line, and what may begin an inline: an emphasis mark that opens has no blank after it.
_MARKED = (
    r"(?m)^[ \t]*(?:[#>~+\-=*_|]|[0-9]{1,9}[.)])|^(?: {4}| {0,3}\t)|  $"
    r"|(?=[`\[*_&<\\])(?:[`\[]|[*_](?=[^ \t\n*_])|&(?=[#A-Za-z])|<(?=[A-Za-z/!?])|\\(?=[!-/:-@\[-`{-~\n]))"
)
#: What may reach over blank lines from the part where it begins, or from one part to another: fences, HTML blocks, definitions.
_REACHING = r"(?i)```|~~~|<[!?]|<(?:script|pre|style|textarea)|\]:|\x01"
_PARTS = r"(?s).+?(?:\n(?:[ \t]*\n)+|\z)"
_YAML = r"(?s)\A---[ \t]*\r?\n(?:(.*?)\r?\n)??---[ \t]*\r?(?:\n|\z)"
_TOML = r"(?s)\A\+\+\+[ \t]*\r?\n(?:(.*?)\r?\n)??\+\+\+[ \t]*\r?(?:\n|\z)"


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_html(text: Column) -> Column:
    """``& < > "`` as named references."""
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def escape_unified_text(text: Column) -> Column:
    return _replaced(text, (("&", "&#x26;"), ("<", "&#x3C;")))


def escape_unified_attribute(text: Column) -> Column:
    return _replaced(text, (("&", "&#x26;"), ('"', "&#x22;"), ("'", "&#x27;"), ("`", "&#x60;")))


def filter_tags(html: Column) -> Column:
    """Start tags of nine elements disarmed; end tags stay."""
    return F.regexp_replace(html, _TAGS, "&lt;")


def external_links(html: Column) -> Column:
    """``rel="nofollow"`` on links to http(s) addresses."""
    return F.regexp_replace(html, _EXTERNAL, '$1 rel="nofollow">')


def lines(text: Column) -> Column:
    """A text's lines (only ``\\n`` ends one), without an empty one after the last line end."""
    parts = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normalize_newlines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` as ``\\n``. The kernel takes texts as they are; this goes before it where files mix line ends."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def frontmatter(text: Column) -> Column:
    """Struct (format, value, body): the block at the very start, raw, and what follows it (no block: null, null, text)."""
    yaml, toml = F.regexp_like(text, F.lit(_YAML)), F.regexp_like(text, F.lit(_TOML))
    kind = F.when(yaml, "yaml").when(toml, "toml")
    value = F.when(yaml, F.regexp_extract(text, _YAML, 1)).when(toml, F.regexp_extract(text, _TOML, 1))
    body = F.when(yaml, F.regexp_replace(text, _YAML, "")).when(toml, F.regexp_replace(text, _TOML, "")).otherwise(text)
    return F.struct(kind.alias("format"), value.alias("value"), body.alias("body"))


def is_plain(text: Column) -> Column:
    """Whether a text surely is paragraphs of plain text, without extensions."""
    return ~F.regexp_like(text, F.lit(_MARKED))


def plain_html(text: Column) -> Column:
    """The HTML of a text for which :func:`is_plain` holds."""
    paragraphs = F.transform(F.split(text, r"\n(?:[ \t]*\n)+"), lambda p: F.regexp_replace(p, r"^[ \t\n]+|[ \t\n]+$", ""))
    shown = F.transform(F.filter(paragraphs, lambda p: p != ""), lambda p: F.concat(F.lit("<p>"), escape_html(F.regexp_replace(p, r" ?\n[ \t]*", "\n")), F.lit("</p>\n")))
    return F.array_join(shown, "")


def route(text: Column) -> Column:
    """A text cut into segments (null: null): those at even places are plain, those at odd places are for the kernel.

    The cuts are where no block can be open: at blank lines before or after parts that are plain and not indented. Where something may reach over
    such lines, the whole text is one segment for the kernel. The segments' HTML, one after the other, is the text's.
    """
    parts = F.transform(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), lambda p: F.struct((is_plain(p) & ~F.regexp_like(p, F.lit(r"\A[ \t]"))).alias("plain"), p.alias("text")))
    # Each part beside the one before it (a plain one stands before the first); the last pair has no part.
    ahead = F.concat(F.array(F.struct(F.lit(True).alias("plain"), F.lit("").alias("text"))), parts)
    changes = F.zip_with(parts, ahead, lambda p, q: F.when(p["plain"] != q["plain"], F.concat(F.lit("\x01"), p["text"])).otherwise(F.coalesce(p["text"], F.lit(""))))
    cut = F.split(F.array_join(changes, ""), "\x01", -1)
    return F.when(is_plain(text), F.array(text)).when(F.regexp_like(text, F.lit(_REACHING)), F.array(F.lit(""), text)).when(text.isNotNull(), cut)


def for_kernel(segments: Column) -> Column:
    """The segments of :func:`route` that the kernel has to see."""
    return F.filter(segments, lambda s, i: i % 2 == 1)


def reassembled(segments: Column, rendered: Column) -> Column:
    """The HTML of all segments in their order, given that of the kernel's."""
    ended = lambda html: F.when((html == "") | F.endswith(html, F.lit("\n")), html).otherwise(F.concat(html, F.lit("\n")))
    last = F.size(segments) - 1
    pieces = F.transform(segments, lambda s, i: F.when(i % 2 == 0, plain_html(s)).when(i == last, F.get(rendered, F.floor(i / 2).cast("int"))).otherwise(ended(F.get(rendered, F.floor(i / 2).cast("int")))))
    return F.array_join(pieces, "")


def heading_slug(text: Column) -> Column:
    """The id of a heading with the given text, before repeats are told apart."""
    return F.lower(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}\p{M}_-]", ""))


def code_language(info: Column) -> Column:
    return F.nullif(F.regexp_extract(info, r"^\s*(\S+)", 1), F.lit(""))


def code_meta(info: Column) -> Column:
    return F.nullif(F.regexp_extract(info, r"^\s*\S+[ \t]+([\s\S]*)", 1), F.lit(""))


def trim_lines(text: Column) -> Column:
    """Blanks around inner line ends removed."""
    return F.regexp_replace(text, r"[ \t]*(\r\n|\n|\r)[ \t]*", "$1")


def mail_candidates(text: Column) -> Column:
    """What looks like mail addresses in a text: a cheap test before the kernel's exact one."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"), F.lit(0))
