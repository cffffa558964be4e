"""Every query with SQL gives the rows that DuckDB gives; the rest run and agree with other routes."""

import math
import random
import time
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillmark import functions as M
from quillmark import operators as R
from quillmark import plans
from quillmark.kernel.html import HtmlRenderer
from quillmark.kernel.tree import TreeBuilder
from quillmark.options import Options
from quillmark.sources import read_markdown, write_json
from quillmark.streaming import read_documents, stream_nodes, windowed_counts


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert _rows(df.columns, df.collect()) == _rows(found.columns, found.fetchall())


def test_plain_route_equals_kernel(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = R.render_html(docs).join(docs.select("doc_id", M.md_to_html(F.col("text")).alias("whole")), "doc_id")
    assert both.where("html <> whole").count() == 0 and both.count() == docs.count()


def test_routed_parts_equal_kernel(spark):
    """Documents of parts that reach over blank lines and parts that don't, cut and put together again."""
    draw = random.Random(11)
    parts = ["plain text\n", "two\nlines\n", " one blank\n", "  two\n", "    code\n", "- item\n", "  more of it\n", "1. one\n", "12) x\n", "2020 was\n", "> quote\n", "# head\n", "head\n===\n", "***\n", "*em* x\n", "a * b ** c\n", "x_y_z\n", "!!! &&& <3 a]b\n",
             "&amp; &x\n", "[l](/u) ![i](/j)\n", "[r]\n", "[r]: /u\n", "```\n", "~~~ py\n", "<div>\n", "<b>x</b>\n", "<!-- c\n", "-->\n", "<script>\n", "<pre>\n", "`c`\n", "a\\\nb\n", "a\\b\n", "end  \n", "\ttab\n", "\n", "\n", "\n\n", " \n", "\t\n\n", "| a |\n|---|\n"]
    calm = [p for p in parts if not p.startswith(("`", "~", "<!", "<s", "<p", "[r]:"))] + ["\n", "\n"] * 8
    rows = [(k, "".join(draw.choices(calm if k % 2 else parts, k=draw.randrange(1, 12))).removesuffix(draw.choice(["", "\n"]))) for k in range(4000)] + [(-1, None), (-2, ""), (-3, "\x01a\n\n*b*"), (-4, "x" * 200_000 + "\n\n*y*")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = R.render_html(docs).join(docs.select("doc_id", "text", M.md_to_html(F.col("text")).alias("whole")), "doc_id")
    assert [r for r in both.where("not html <=> whole").take(3)] == [] and both.count() == len(rows)
    sent = R.routing(docs).agg(F.sum("kernel_chars"), F.sum("n_chars"), F.count_if(F.expr("kernel_chars > 0 and kernel_chars < n_chars"))).first()
    assert sent[0] < sent[1] and sent[2] > 300


def test_label_keys(spark):
    labels = ["ΑΣ", "Α\u00a0 Σ ", "ẞ ß SS", " a\n\tB ", None]
    from quillmark.kernel.chars import label_key

    found = spark.createDataFrame([(x,) for x in labels], "label string").select(M.label_key(F.col("label"))).collect()
    assert [r[0] for r in found] == [None if x is None else label_key(x) for x in labels] and found[0][0] == "ασ" and found[1][0] == "α σ" and found[2][0] == "ss ss ss"


def test_node_table_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "# a", "x")], "doc_id long, text string, type string")
    assert {(r.doc_id, r.type) for r in R.nodes(docs).collect()} == {(2, "root"), (3, "root"), (3, "heading"), (3, "text")}


def test_filters_reach_the_scan(spark):
    tree = R.nodes(spark.read.parquet(f"{SF}/documents.parquet"), types=["heading"], inline=False).where("doc_id = 5")
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "n_chars" not in plan and plan.count("ArrowEvalPython") == 1


RELATIONS = [n for n in plans.QUERIES if n not in ("md_language_summary", "md_escape", "md_tagfilter", "md_line_table", "md_frontmatter", "md_external_links", "md_mail_candidates", "md_native_helpers",  # without the kernel
                                             "md_routing", "md_latest_revisions", "md_phase_profile")]  # runs a stream before; runs each phase by itself to time it, in one MapInArrow (below)


@pytest.mark.parametrize("name", RELATIONS)
def test_each_relation_parses_once(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line and "tree_pass" not in line for line in plan.split("\n")) == 1  # passes over node rows aren't parses


def test_phase_profile(spark):
    docs = spark.createDataFrame([("# a *b*",), (None,), ("",)], "text string")
    row = R.phase_profile(docs).first()
    assert (row["documents"], row["characters"]) == (2, 7) and row["blocks"] > 0 and row["tree"] > 0 and row["html"] > 0
    assert tuple(R.phase_profile(docs.limit(0)).first()) == (0, 0, 0.0, 0.0, 0.0)
    plan = plans.QUERIES["md_phase_profile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ReadSchema: struct<text:string>" in plan


def test_node_types_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    builder = TreeBuilder(Options.full())
    wanted = Counter()
    for d in docs:
        for row in builder.build(d.text):
            wanted.update([(d.lang, row.type), (d.lang, None), (None, None)])
    assert {(r.language, r.type): r.n_nodes for r in plans.QUERIES["md_node_types"](spark, SF).collect()} == wanted


def test_renderings_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    render = HtmlRenderer().render
    assert {r.doc_id: r.html for r in plans.QUERIES["md_render_documents"](spark, SF).collect()} == {d.doc_id: render(d.text) for d in docs}


def test_descendants_and_inside(spark):
    tree = R.nodes(spark.createDataFrame([(1, "> *a* b\n\n*c*"), (2, "x")], "doc_id long, text string"))
    below = R.descendants(tree, tree.where("type = 'blockquote'"))
    assert sorted(r.value for r in below.where("type = 'text'").collect()) == [" b", "a"]
    assert sorted(r.value for r in R.inside(tree, "emphasis").where("type = 'text'").collect()) == ["a", "c"]


def test_emoji_of_the_caller(spark):
    html = spark.range(1).select(M.md_to_html(F.lit(":mine: :rocket:"), Options(emoji=True), {"mine": "M"}).alias("html")).first().html
    assert html == "<p>M :rocket:</p>\n"


def test_windowed_counts_and_json(spark, tmp_path):
    docs = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, '# a' as text union all select timestamp'2024-01-01 01:10:00', 'b'")
    assert {(r.type, r.n_nodes) for r in windowed_counts(docs, "ts").groupBy("type").agg(F.sum("n_nodes").alias("n_nodes")).collect()} == {("root", 2), ("heading", 1), ("paragraph", 1), ("text", 2)}
    write_json(docs.select(M.md_to_json(F.col("text")).alias("json")), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("type = 'root'").count() == 2


def test_positions_change_nothing_else(spark):
    docs = spark.createDataFrame([(1, "# a\n\n- b *c*\n")], "doc_id long, text string")
    places = [f.name for f in M.NODE if f.name.startswith(("start_", "end_"))]
    with_places, without = R.nodes(docs, positions=True), R.nodes(docs)
    assert with_places.drop(*places).collect() == without.drop(*places).collect()
    assert without.where(" or ".join(f"{p} is not null" for p in places)).count() == 0


def test_sql_functions(spark):
    M.register(spark, Options.gfm())
    row = spark.sql("select md_to_html('~~a~~') as html, size(md_nodes('*a*')) as n, variant_get(parse_json(md_to_json('# a')), '$.children[0].depth', 'int') as depth").first()
    assert (row.html, row.n, row.depth) == ("<p><del>a</del></p>\n", 4, 1)


def test_table_function_of_null_and_empty_texts(spark):
    M.register(spark, prefix="t_")
    found = spark.sql("select k, b.type from values (1, null), (2, ''), (3, 'a') as d(k, text), lateral t_blocks(text) b").collect()
    assert {tuple(r) for r in found} == {(2, "root"), (3, "root"), (3, "paragraph")}
    rows = spark.sql("select doc_id, type, parent_id, end_line from t_block_table(table(select k, text from values (1l, null), (2l, ''), (3l, 'a\n\n# b'), (null, 'c') as d(k, text)))").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, [(2, "root", None, 1), (3, "root", None, 3), (3, "paragraph", 0, 1), (3, "heading", 0, 3), (None, "root", None, 1), (None, "paragraph", 0, 1)]))
    assert spark.sql("select * from t_block_table(table(select id, 'x' as text from range(0)))").count() == 0


def test_references_and_line_ends(spark):
    text = F.lit("&amp;quot; &am &nosuch; &#65;&#x42; &amp")
    row = spark.range(1).select(M.decoded(text).alias("a"), M.decoded(F.lit(None).cast("string")).alias("b"), M.normalize_newlines(F.lit("a\r\nb\rc\r\r\n")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("&quot; &am &nosuch; AB &amp", None, "a\nb\nc\n\n")


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_bytes(b"# A\n\xff")
    docs = read_markdown(spark, str(tmp_path / "md"))
    assert docs.select("text").first()[0] == "# A\n�"
    docs.write.parquet(str(tmp_path / "in"))
    stream = stream_nodes(read_documents(spark, str(tmp_path / "in"), docs.schema), types=["heading"])
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    began = time.time()
    assert query.awaitTermination(60) and time.time() - began < 60
    assert spark.read.parquet(str(tmp_path / "out")).select("type", "depth").collect() == [("heading", 1)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4 and set(entry.oracle_sql()) <= set(entry.queries())
