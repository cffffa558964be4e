"""Column functions: the native ones as Catalyst expressions, the kernel's as Arrow functions."""

from .kernel import NODE, blocks_function, blocks_table_function, decoded, label_key, md_nodes_array, md_to_html, md_to_html_each, md_to_json, md_to_unified_html, node_columns, register
from .native import (
    code_language,
    code_meta,
    escape_html,
    escape_unified_attribute,
    escape_unified_text,
    external_links,
    filter_tags,
    for_kernel,
    frontmatter,
    heading_slug,
    is_plain,
    lines,
    mail_candidates,
    normalize_newlines,
    plain_html,
    reassembled,
    route,
    trim_lines,
)

__all__ = [
    "NODE", "blocks_function", "blocks_table_function", "code_language", "code_meta", "decoded", "escape_html", "escape_unified_attribute", "escape_unified_text", "external_links",
    "filter_tags", "for_kernel", "frontmatter", "heading_slug", "is_plain", "label_key", "lines", "mail_candidates", "md_nodes_array", "md_to_html", "md_to_html_each",
    "md_to_json", "md_to_unified_html", "node_columns", "normalize_newlines", "plain_html", "reassembled", "register", "route", "trim_lines",
]
