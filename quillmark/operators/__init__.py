"""Relations over the node table."""

from .profile import phase_profile
from .relational import (
    code_blocks,
    definitions,
    footnotes,
    heading_slugs,
    inside,
    leaf_text,
    links,
    node_counts,
    nodes,
    outline,
    render_html,
    resolve_references,
    routing,
    table_cells,
    tasks,
    used_footnotes,
)
from .rendering import nodes_to_html, nodes_to_json
from .shortcodes import replace_shortcodes
from .sketches import estimates, merge_sketches, sketch_nodes
from .trees import all_ancestors, descendants, drop_subtrees, insert_subtrees, nearest_ancestor, renumber, unwrap

__all__ = [
    "all_ancestors", "code_blocks", "definitions", "descendants", "drop_subtrees", "estimates", "footnotes", "heading_slugs", "insert_subtrees", "inside", "leaf_text",
    "links", "merge_sketches", "nearest_ancestor", "node_counts", "nodes", "nodes_to_html", "nodes_to_json", "outline", "phase_profile", "render_html", "renumber", "replace_shortcodes",
    "resolve_references", "routing", "sketch_nodes", "table_cells", "tasks", "unwrap", "used_footnotes",
]
