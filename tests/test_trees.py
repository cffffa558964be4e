"""Folds, ancestors and edits of node rows against the kernel and plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillmark import functions as M
from quillmark import operators as R
from quillmark.options import Options

TEXTS = [
    "", "# a *b* `c`\n\ntext  \nbreak <b>raw</b> &amp;", "- a\n- b\n\n  c\n- d", "1. x\n   - y\n\n     z\n2. w", "3) q", "> a\n> - b\n>\n> c", "> ", "> [a]: b", "[r]: /u 'T \"q\"'\n\n[x][r] ![*i*][r] [r] [r][] [none]",
    "![alt](/i \"t\") [*l*](<a b>)", "```py x\n<&>\n```\n\n    code", "***", "<div>\nraw\n</div>", "- a\n  - b\n    - c\n\n- d", "-\n- ```\n  x\n  ```", "a `b\nc` &quot; <",
    "| a | b |\n|-|:-:|\n| 1 | 2 | 3 |\n| x |\n", "| only | head |\n|--|--|", "a\n: b\n: c\n\nd\n\n: e", "- [x] a\n- b\n\n  c", "::v[x *y*]{#a k=v}\n\n:::n[l]{.c}\na\n\nb\n:::\n\n:t[z]", "x[^1]\n\n[^1]: n\n\n    m", "---\na: b\n---\nx ~~y~~ 😀 www.a.example",
]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(7)
    pieces = ["# h\n", "- a\n", "  - b\n", "> q\n", "\n", "    i\n", "1. n\n", "*e* **s** `c`\n", "[r] ![r][]\n", "[r]: /u\n", "```\n", "| a |\n|-|\n| b |\n", "text &amp; <\n", ": d\n", ":::n\n", "- [ ] t\n"]
    rows = TEXTS + ["".join(draw.choices(pieces, k=draw.randrange(1, 14))) for _ in range(300)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)] + [(None, "null *key*"), (-1, None)], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("options", [Options(), Options.gfm(), Options.full()])
def test_folds_equal_the_kernel(spark, docs, options):
    tree = R.nodes(docs, options=options, positions=True)
    html = {r.doc_id: r.html for r in R.nodes_to_html(tree).collect()}
    json = {r.doc_id: r.json for r in R.nodes_to_json(tree).collect()}
    whole = docs.select("doc_id", M.md_to_unified_html(F.col("text"), options).alias("html"), M.md_to_json(F.col("text"), options, True).alias("json")).where("html is not null").collect()
    assert html == {r.doc_id: r.html for r in whole} and json == {r.doc_id: r.json for r in whole}


def test_without_positions_and_with_few_columns(spark, docs):
    tree = R.nodes(docs)
    whole = {r.doc_id: r.json for r in docs.select("doc_id", M.md_to_json(F.col("text")).alias("json")).where("json is not null").collect()}
    assert {r.doc_id: r.json for r in R.nodes_to_json(tree).collect()} == whole
    thin = tree.where("doc_id = 4").select("doc_id", "node_id", "parent_id", "depth_in_tree", "type", "value", "ordered", "start", "spread")
    assert [r.html for r in R.nodes_to_html(thin).collect()] == ['<ol start="3">\n<li>q</li>\n</ol>']
    assert R.nodes_to_html(tree.limit(0)).count() == R.nodes_to_json(tree.limit(0)).count() == 0


def test_rows_without_a_root(spark):
    tree = R.nodes(spark.createDataFrame([(1, "# a\n\nb")], "doc_id long, text string")).where("type <> 'root'")
    assert R.nodes_to_html(tree).first().html == "<h1>a</h1>\n<p>b</p>"


def test_renumbering_a_tree_changes_nothing(spark, docs):
    tree = R.nodes(docs, options=Options.full())
    again = R.renumber(tree, "doc_id", F.col("node_id"))
    assert again.columns == tree.columns
    numbers = ("doc_id", "node_id", "parent_id", "ordinal", "depth_in_tree", "subtree_end", "type")
    assert sorted(map(repr, tree.select(*numbers).collect())) == sorted(map(repr, again.select(*numbers).collect()))


def kids_of(rows):
    """A tree as nested lists, from node_id and parent_id alone."""
    nodes = {r.node_id: [r.type, r.value, []] for r in rows}
    for r in sorted(rows, key=lambda r: r.node_id):
        if r.parent_id is not None:
            nodes[r.parent_id][2].append(nodes[r.node_id])
    return nodes[0] if nodes else None


def well_formed(rows):
    rows = sorted(rows, key=lambda r: r.node_id)
    by_id = {r.node_id: r for r in rows}
    assert [r.node_id for r in rows] == list(range(len(rows)))
    for r in rows:
        below = [x.node_id for x in rows if r.node_id < x.node_id <= r.subtree_end]
        assert all(by_id[b].parent_id is not None and by_id[b].parent_id >= r.node_id for b in below)
        assert r.parent_id is None or (by_id[r.parent_id].depth_in_tree == r.depth_in_tree - 1 and by_id[r.parent_id].subtree_end >= r.subtree_end)
        assert r.ordinal == sum(x.parent_id == r.parent_id and x.node_id < r.node_id for x in rows)


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_drop_and_unwrap_by_plain_loops(spark, docs):
    tree = R.nodes(docs.where("doc_id < 120"))
    before = {k: kids_of(v) for k, v in grouped(tree).items()}
    gone = ("listItem", "emphasis", "heading")

    def pruned(node):
        return [node[0], node[1], [pruned(k) for k in node[2] if k[0] not in gone]]

    def lifted(node):
        out = []
        for k in node[2]:
            k = lifted(k)
            out += k[2] if k[0] in gone else [k]
        return [node[0], node[1], out]

    for edit, plain in ((R.drop_subtrees, pruned), (R.unwrap, lifted)):
        after = grouped(edit(tree, F.col("type").isin(*gone)))
        for rows in after.values():
            well_formed(rows)
        assert {k: kids_of(v) for k, v in after.items()} == {k: plain(v) for k, v in before.items()}
    assert R.drop_subtrees(tree, F.col("type") == "root").count() == 0
    assert R.drop_subtrees(tree, F.lit(None).cast("boolean")).count() == tree.count()


def test_inserts(spark):
    tree = R.nodes(spark.createDataFrame([(1, "a\n\n- b\n- c"), (2, "x")], "doc_id long, text string"))
    kinds = {r.node_id: r.type for r in tree.where("doc_id = 1").collect()}
    assert kinds == {0: "root", 1: "paragraph", 2: "text", 3: "list", 4: "listItem", 5: "paragraph", 6: "text", 7: "listItem", 8: "paragraph", 9: "text"}
    text = lambda doc, anchor, place, nth, value: [(doc, anchor, place, nth, 0, 0, "paragraph", None), (doc, anchor, place, nth, 1, 1, "text", value)]
    rows = [r for a in (
        (1, 1, "before", 0, "P"), (1, 1, "after", 1, "R"), (1, 1, "after", 0, "Q"), (1, 4, "first", 0, "S"), (1, 4, "last", 0, "T"), (1, 7, "last", 0, "U"), (1, 3, "after", 0, "V"), (1, 0, "last", 0, "W"),
        (1, 0, "first", 0, "O"), (2, 0, "last", 0, "y"), (2, 99, "last", 0, "lost"), (3, 0, "last", 0, "no such document")) for r in text(*a)]
    fragments = spark.createDataFrame(rows, "doc_id long, anchor int, place string, nth int, node_id int, depth_in_tree int, type string, value string").repartition(3)
    after = R.insert_subtrees(tree, fragments)
    for found in grouped(after).values():
        well_formed(found)
    html = {r.doc_id: r.html for r in R.nodes_to_html(after).collect()}
    assert html == {1: "<p>O</p>\n<p>P</p>\n<p>a</p>\n<p>Q</p>\n<p>R</p>\n<ul>\n<li>S\nb\nT</li>\n<li>c\nU</li>\n</ul>\n<p>V</p>\n<p>W</p>", 2: "<p>x</p>\n<p>y</p>"}
    assert R.insert_subtrees(tree, fragments.limit(0)).count() == tree.count()


def test_ancestors_by_plain_loops(spark, docs):
    tree = R.nodes(docs, options=Options.gfm(), types=["blockquote", "list", "listItem", "text", "emphasis"])
    rows = grouped(tree)
    condition = F.col("type").isin("listItem", "blockquote")
    near = {(r.doc_id, r.node_id): r.ancestor_id for r in R.nearest_ancestor(tree, condition).collect()}
    pairs = sorted((repr(r.doc_id), r.node_id, r.ancestor_id) for r in R.all_ancestors(tree, condition).collect())
    wanted, nearest = [], {}
    for doc, found in rows.items():
        for r in found:
            above = [a.node_id for a in found if a.type in ("listItem", "blockquote") and a.node_id < r.node_id <= a.subtree_end]
            nearest[doc, r.node_id] = max(above, default=None)
            wanted += [(repr(doc), r.node_id, a) for a in above]
    assert near == nearest and pairs == sorted(wanted)
    below = sorted((repr(r.doc_id), r.node_id, r.ancestor_id) for r in R.descendants(tree, tree.where(condition)).collect())
    assert below == pairs


def test_shortcodes_by_a_plain_loop(spark):
    """Against a scan from left to right, over texts of colons and names, known and unknown."""
    draw = random.Random(2)
    known = {"a": "A", "b": "B☆", "long_name+1": "L"}
    texts = ["".join(draw.choices([":", ":", "a", "b", "c", "long_name+1", " ", "::", ":a:"], k=draw.randrange(1, 12))) for _ in range(400)]

    def scanned(text):
        out, at = "", 0
        while at < len(text):
            end = text.find(":", at + 1)
            if text[at] == ":" and end > 0 and text[at + 1 : end] in known:
                out, at = out + known[text[at + 1 : end]], end + 1
            else:
                out, at = out + text[at], at + 1
        return out

    rows = [(k, "text", t, 0, None) for k, t in enumerate(texts)] + [(900, "inlineCode", ":a:", 1, 5), (901, "root", None, 1, 6), (902, "text", "", 0, None)]
    tree = spark.createDataFrame(rows, "doc_id long, type string, value string, node_id int, _last int")
    names = spark.createDataFrame([(*kv,) for kv in known.items()] + [("a", "B"), ("", "E"), (None, "N"), ("c", None)], "name string, symbol string")
    found = {r.doc_id: r.value for r in R.replace_shortcodes(tree.drop("_last"), names).collect()}
    assert found == {k: scanned(t) for k, t in enumerate(texts)} | {900: ":a:", 901: None, 902: ""}
    assert R.replace_shortcodes(tree.drop("_last"), names.limit(0)).count() == len(rows)


def test_a_deep_document_is_linear(spark):
    """10^5 nodes in each other, as rows made by Spark: the nearest one above each is the one before it."""
    n = 100_000
    deep = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("node_id"), (F.col("id") - 1).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.col("id").cast("int").alias("depth_in_tree"), F.lit(n - 1).alias("subtree_end"), F.lit("blockquote").alias("type"))
    began = time.time()
    assert R.nearest_ancestor(deep, F.lit(True)).where("ancestor_id = node_id - 1").count() == n - 1
    assert R.renumber(deep, "doc_id", F.col("node_id")).where(f"subtree_end = {n - 1} and coalesce(parent_id, -1) = node_id - 1").count() == n
    assert R.drop_subtrees(deep, F.col("node_id") == n // 2).count() == n // 2
    assert time.time() - began < 60


def test_one_exchange_and_one_parse(spark, docs):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    tree = R.nodes(docs)
    for df, exchanges in ((R.nearest_ancestor(tree, F.col("type") == "list"), 1), (R.drop_subtrees(tree, F.col("type") == "list"), 1), (R.nodes_to_html(tree), 1), (R.nodes_to_json(tree), 1)):
        parses = [line for line in plan(df).split("\n") if "ArrowEvalPython" in line and "tree_pass" not in line]
        assert len(parses) == 1 and plan(df).count("Exchange hashpartitioning") == exchanges
