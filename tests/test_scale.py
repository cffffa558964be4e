"""What the driver's larger tables need: bounded batches, one parse for a shape, no exchange twice, rows over all cores."""

import random

import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillmark import functions as M
from quillmark import operators as R
from quillmark import plans
from quillmark.functions import kernel as K
from quillmark.kernel.shapes import Shapes
from quillmark.operators.trees import values
from quillmark.options import Options

PIECES = ["# ", "- ", "  ", "    ", "> ", "\n", "\n\n", "1. ", "10) ", "7", "abc", "A1", "*", "**", "_", "`", "[", "]", "(", ")", "![", "](/u/", '"t x"', "...", ".", "%s 5%", "===", "\n---\n", "* * *",
          "~~~", "``` py x", "12", "x2y", "1.", "!", "{a}", "|", "www.a.b", "é", "&amp;", "<b>", ": ", "\t", "[r]: /u\n", "[r]", "1234567890.", "  \n", "𠀀"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_texts_comes_in_pieces():
    """Each text has 41 nodes: no piece holds more than CHUNK_NODES and one text's, and nulls keep their place."""
    texts = ["\n\n".join("*ab*"[k % 2 :] + f" {j}" for k in range(10)) for j in range(3000)] + [None, ""]
    sizes = []
    for piece in K.nodes_arrays(texts, Options(), None, True, False):
        most = max(len(v) for v in piece.to_pylist() if v is not None)
        assert len(piece.flatten()) <= K.CHUNK_NODES + most
        sizes.append(len(piece))
    assert len(sizes) > 1 and sum(sizes) == len(texts)
    assert K.nodes_array(texts[-3:], Options(), None, True, False).to_pylist()[1] is None


@pytest.mark.parametrize(("types", "inline"), [(None, True), (None, False), (frozenset(["text", "listItem", "heading"]), True)])
def test_shapes_change_no_tree(types, inline):
    draw = random.Random(11)
    table = lambda text: K._table(text, K._builder(0, inline), types, inline, False)
    shapes = Shapes(table)
    for _ in range(4000):
        text = "".join(draw.choices(PIECES, k=draw.randrange(24)))
        assert shapes.columns(text) == table(text), text


LABELS = ["[r]: /u\n", "[R]: /v 'T t'\n", "[a b]: b\n", "[A  b]", "[a\nb]", "[r]", "[R][]", "![x][r]", "[*r* x][R]", "[12]: /n\n", "[12]", "[12.]", "word ", "Word ", "r ", "\n\n", "> ", "- ", "[", "]", "]:", ": ", "%s", "[b]: <", "/u", '"q"']


def test_labels_have_shapes_and_long_ones_none():
    draw = random.Random(5)
    parsed = []
    table = lambda text: parsed.append(text) or K._table(text, K._builder(0, True), None, True, False)
    shapes = Shapes(table)
    for _ in range(4000):
        text = "".join(draw.choices(LABELS, k=draw.randrange(16)))
        assert shapes.columns(text) == table(text), text
    parsed.clear()
    for k in range(100):
        columns = shapes.columns(f"# n{k}\n\n[*b{k}*][r] ![t{k}][R] [K{k}]\n\n[r]: /part/{k} 't{k}'\n[K{k}]: /k\n")
        assert columns["identifier"].count("r") == 3 and columns["identifier"].count(f"k{k}") == 2
    assert len(parsed) == 1
    for n in (996, 999, 1000, 1003):
        for words in ("x" * n, "x " * (n // 2), "x y." * (n // 4)):
            text = f"[{words}]\n\n[{words}]: /u"
            assert shapes.columns(text) == table(text)


def test_folds_ship_no_nested_columns(spark):
    """A list that is null made each row as dear as its batch was long. Nulls in maps and lists, their order and quotes stay."""
    tree = R.nodes(spark.createDataFrame([(1, "| a | b |\n|:--|---|\n| c | d |\n\np")], "doc_id long, text string"), options=Options.gfm())
    named = tree.withColumn("properties", F.when(F.col("type") == "paragraph", F.create_map(F.lit("z"), F.lit('"é\\'), F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("1"))))
    html = R.nodes_to_html(named)
    assert "StructsToJsonEvaluator" in plan_of(html)
    assert [r.html for r in html.collect()] == ['<table>\n<thead>\n<tr>\n<th align="left">a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td align="left">c</td>\n<td>d</td>\n</tr>\n</tbody>\n</table>\n<p z="&#x22;é\\" b="1">p</p>']


def test_folds_need_no_numbers_anew(spark):
    """Numbers with gaps are in preorder too: without new ones, neither a pass nor a second exchange stands between the nodes and their HTML."""
    text = "# a\n\n- x\n\n- y\n  1. z\n\n> [r] [k]\n\n[r]: /u\n[k]: /k\n\n- p\n- q"
    tree = R.nodes(spark.createDataFrame([(1, text), (2, text + "!")], "doc_id long, text string"))
    for gone in (F.expr("identifier = 'r'"), F.expr("type = 'listItem' and ordinal = 0"), F.expr("type = 'blockquote'"), F.col("node_id") == 0):
        anew, old = R.drop_subtrees(tree, gone), R.drop_subtrees(tree, gone, numbered=False)
        for fold in (R.nodes_to_html, R.nodes_to_json):
            assert sorted(map(tuple, fold(old).collect())) == sorted(map(tuple, fold(anew).collect()))
    plan = plan_of(R.nodes_to_html(old))
    assert plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") == 1


def test_values_are_those_of_the_arrays():
    for kind, some in ((pa.int32(), [1, -2]), (pa.int64(), [2**62 + 1, 0]), (pa.string(), ["a", ""]), (pa.large_string(), ["é"]), (pa.bool_(), [True, False]), (pa.timestamp("us"), [5]), (pa.list_(pa.string()), [["x", None]])):
        for given in (some, [*some, None], [None], [None, *some, None], []):
            column = pa.array(given, kind)
            assert values(column) == column.to_pylist() and [*map(type, values(column))] == [*map(type, column.to_pylist())]
            assert values(column.slice(1)) == column.slice(1).to_pylist()


def test_one_parse_for_a_shape_and_a_bounded_store(monkeypatch):
    parsed = []
    table = lambda text: parsed.append(text) or K._table(text, K._builder(0, True), None, True, False)
    shapes = Shapes(table)
    for k in range(100):
        assert shapes.columns(f"# a {k}\n\n1. x{k} *y*")["text"][1] == f"a {k}"
    assert len(parsed) == 1
    monkeypatch.setattr("quillmark.kernel.shapes._KEPT", 50)
    for k in range(100):
        shapes.columns("# a\n\n" * k)
    assert len(shapes.known) < 40


@pytest.mark.parametrize(("name", "exchanges"), [("md_pruned_items", 4), ("md_all_ancestors", 5)])
def test_a_tree_is_laid_by_document_once(spark, name, exchanges):
    """The documents' aggregation, their spreading, the tree's and the result's aggregation (and row numbers, and distinct nodes)."""
    assert plan_of(plans.QUERIES[name](spark, SF)).count("Exchange hashpartitioning") <= exchanges


def test_passes_ship_no_columns_that_nobody_reads(spark):
    tree = R.nodes(spark.createDataFrame([(1, "> a\n> > b")], "doc_id long, text string"))
    found = R.all_ancestors(tree, F.col("type") == "blockquote").where("type = 'text'").select("node_id", "ancestor_id")
    assert "identifier" not in [line for line in plan_of(found).split("\n") if "Exchange hashpartitioning" in line or "Window" in line][0]
    assert sorted(map(tuple, found.collect())) == [(3, 1), (6, 1), (6, 4)]


@pytest.mark.parametrize("name", ["md_node_count", "md_pruned_items", "md_nearest_items", "md_topk_docs", "md_ordered_lists", "md_inserted_paragraphs"])
def test_documents_of_an_aggregation_go_to_all_cores(spark, name):
    """By a fixed number: otherwise Spark joins small texts to few partitions by their bytes."""
    assert "REPARTITION_BY_NUM" in plan_of(plans.QUERIES[name](spark, SF))


AHEAD = ["", "Orders\n\n", "# h %s\n\n", "a\nb *c*\n\n", "***\n\n", "- a\n\n", "1. q\n\n", "> q\n\n", "```\n\n", "    c\n\n", "x\n===\n\n", "\n\n", "p\n\n# q\n\n"]
MARKS = ["1. ", "2) ", "- ", "> ", "# ", "  ", "    ", "* ", "3. ", "      ", ""]
WORDS = ["a", "B2", "12", "*x*", "_y_", "`c`", "%s 5%", "x.", "7.", "[l](/u)", "![i](/j)", "[r]", "**b** c", "a  ", "---", "===", "```", "12)", "*", "> q", "-", ">", "1.", "#"]


@pytest.mark.parametrize(("types", "inline"), [(None, True), (None, False), (frozenset(["text", "listItem"]), True), (frozenset(["text", "list", "root"]), True)])
def test_items_have_shapes_of_their_own(types, inline):
    draw = random.Random(9)
    builder = K._builder(0, inline)
    table = lambda text: K._table(text, builder, types, inline, False)
    parsed = []
    shapes = Shapes(table, lambda text: parsed.append(text) or K._table(text, builder, None, inline, False), types)
    for _ in range(3000):
        bullet, words = draw.choice("-*+"), draw.choice([WORDS, WORDS[:14], WORDS[:14]])
        line = lambda: "\n  " + draw.choice(MARKS) + draw.choice(MARKS) + " ".join(draw.choices(words, k=draw.randrange(1, 3)))
        items = [(bullet if draw.random() < 0.97 else "-") + " " + draw.choice(MARKS[:5] + [""] * 6) + draw.choice(words) + "".join(line() for _ in range(draw.randrange(4))) for _ in range(draw.randrange(1, 5))]
        text = draw.choice(AHEAD) + "\n".join(items) + draw.choice(["", "", "\n", "\n\n", "\n  ", "\nx"])
        assert shapes.columns(text) == table(text), text
    parsed.clear()
    for k in range(200):  # as many shapes as a whole as there are lists, but a few of an item
        text = "Orders\n\n" + "\n".join(f"- O {k}{j}" + "".join(f"\n  1. line *{draw.randrange(9)}*" for _ in range(draw.randrange(1, 8))) for j in range(10))
        assert shapes.columns(text) == table(text)
    assert len(parsed) <= 1 + 2 * 7


def test_an_ancestor_brings_its_columns_along(spark):
    """Without an exchange by ancestor and a second sort."""
    texts = ["- a\n  1. b\n  1. c\n     - d\n- e\n\nf", "x\n\n- y\n  - z"]
    tree = R.nodes(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).withColumn("name", F.concat_ws("-", "doc_id", "node_id"))
    found = R.nearest_ancestor(tree, F.col("type") == "listItem", carried={"above": "name", "kind": "type"}).collect()
    assert len(found) == tree.count() and any(r.above for r in found)
    for r in found:
        assert (r.above, r.kind) == ((None, None) if r.ancestor_id is None else (f"{r.doc_id}-{r.ancestor_id}", "listItem"))
    plan = plan_of(plans.QUERIES["md_nearest_items"](spark, SF))
    assert "ancestor_id" not in "".join(line for line in plan.split("\n") if "Exchange" in line or "Sort" in line)


@pytest.mark.parametrize("rows", [1, 3, 50, 10_000])
def test_folds_of_alike_subtrees(spark, rows):
    """Batches that end anywhere, lists that a later item makes loose, references ahead of their definitions, texts to escape."""
    draw = random.Random(rows)
    pieces = ["- a & <b>\n", "  1. *x* y\n", "- c\n", "\n", "  z\n", "  - n\n\n    m\n", "[r] ![r][] [k][r]\n\n", "[r]: /u 'T'\n\n", "# h `c`\n", "> q\n> - s\n", "par\nagraph  \nbr\n\n", "1. one\n", "2. two\n"]
    texts = ["".join(draw.choices(pieces, k=draw.randrange(1, 16))) for _ in range(120)]
    texts += ["\n".join(f"- i{j}\n  - k{j}" for j in range(20)) + "\n\n- loose", "\n".join(f"- i{j}\n  # h\n  p" for j in range(9)), "| a | b |\n|-|:-|\n| c | *d* | e |\n| f |", ""]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        html = {r.doc_id: r.html for r in R.nodes_to_html(R.nodes(docs, options=Options.gfm())).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = docs.select("doc_id", M.md_to_unified_html(F.col("text"), Options.gfm()).alias("html")).collect()
    assert html == {r.doc_id: r.html for r in whole}


def test_html_takes_one_parse_and_one_fold(spark):
    """Numbering nodes anew needs no pass in Python, nor lists and references sorts of their own, and a fold reads few columns."""
    plan = plan_of(plans.QUERIES["md_pruned_lists"](spark, SF)).split("\n")
    tree = plan[: next(k for k, line in enumerate(plan) if "Exchange" in line)]
    assert sum("ArrowEvalPython" in line for line in plan) == 1
    assert sum("Sort [" in line for line in tree) == 2 and not any("identifier" in line for line in tree if "Sort [" in line or "Window [" in line)
    fold = next(line for line in plan if "MapInArrow" in line)
    assert "_head" in fold and "reference_type" not in fold and "depth_in_tree" not in fold


def test_inserts_are_laid_by_document_alone(spark):
    """Nodes once and lines twice; neither by anchor nor behind the numbering."""
    plan = plan_of(plans.QUERIES["md_inserted_paragraphs"](spark, SF))
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(exchanges) == 3 and all("REPARTITION_BY_NUM" in line and "anchor" not in line for line in exchanges)
