"""The parser's options and presets, and their bit mask."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """Extensions, all off by default; the order of the fields is that of the mask's bits."""

    strikethrough: bool = False
    tasklist: bool = False
    autolink: bool = False
    tagfilter: bool = False
    tables: bool = False
    hard_wraps: bool = False
    diagram: bool = False
    heading_ids: bool = False
    frontmatter: bool = False
    footnotes: bool = False
    emoji: bool = False
    external_links: bool = False
    deflist: bool = False
    directives: bool = False

    @staticmethod
    def gfm() -> Options:
        """GitHub's tables, task lists, strikethrough, literal autolinks and tag filter."""
        return Options(strikethrough=True, tasklist=True, autolink=True, tagfilter=True, tables=True)

    @staticmethod
    def full() -> Options:
        """Everything but hard wraps, heading ids and external links."""
        return Options.from_flags(sum(1 << k for k, f in enumerate(fields(Options)) if f.name not in ("hard_wraps", "heading_ids", "external_links")))

    @property
    def flags(self) -> int:
        return sum(1 << k for k, f in enumerate(fields(self)) if getattr(self, f.name))

    @staticmethod
    def from_flags(flags: int) -> Options:
        return Options(**{f.name: bool(flags >> k & 1) for k, f in enumerate(fields(Options))})
