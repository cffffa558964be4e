"""Markdown is written from the relational tables, parsed back, and held against the tables themselves."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as M
from .. import operators as R
from ..options import Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FULL = Options.full()


def _query(sql: str | None = None):
    def add(build):
        name = build.__name__.strip("_")
        QUERIES[name] = build
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return add


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Spark SQL over tables of ``sf_dir``, written ``{name}`` in the text."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows over all cores where there are fewer files than cores (a file with one row group is one task).

    With a ``key``, dealt by it to as many partitions as shuffles have: documents written by an aggregation are small, and Spark
    would put them together by their bytes, though the kernel's time follows from how many there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if key:
        return dealt(df, F.xxhash64(key))  # by the key itself it would be dropped behind the aggregation
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def dealt(df: DataFrame, key: str | Column) -> DataFrame:
    """Rows dealt by a key to as many partitions as shuffles have, however few bytes they are; an aggregation or window by the key takes them as they lie."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def _joined(order: str, piece: str, separator: str = r"\n") -> str:
    """SQL that joins ``piece`` of a group's rows in the order of ``order``."""
    return f"array_join(transform(array_sort(collect_list(struct({order} as k, {piece} as s))), x -> x.s), '{separator}')"


# Native functions.


@_query("select lang, count(*) as n_docs, sum(len(string_split(text, chr(10))))::bigint as n_lines, "
        "sum(length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')))::bigint as n_chars from documents group by lang")
def md_language_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n_lines = F.sum(F.size(F.split("text", "\n", -1)).cast("long"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), n_lines.alias("n_lines"), F.sum(F.length(M.escape_html(F.col("text"))).cast("long")).alias("n_chars"))


@_query("select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as html from documents")
def md_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.escape_html(F.col("text")).alias("html"))


@_query("select page_id, regexp_replace(html, '(?i)<(title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext)([ \\t\\n\\r\\f>/]|$)', '&lt;\\1\\2', 'g') as html from pages")
def md_tagfilter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.filter_tags(F.col("html")).alias("html"))


@_query("select doc_id, (i - 1)::int as line, s[i] as text from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from "
        "(select doc_id, case when text = '' then [] when text like '%' || chr(10) then string_split(text, chr(10))[:-2] else string_split(text, chr(10)) end as s from documents))")
def md_line_table(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(M.lines(F.col("text"))).alias("line", "text"))


@_query("select p_partkey, 'yaml' as format, 'name: ' || p_name || chr(10) || 'size: ' || p_size as value, '# ' || p_brand || chr(10) as body from part")
def md_frontmatter(spark, sf_dir):
    docs = _sql(spark, sf_dir, r"select p_partkey, concat('---\nname: ', p_name, '\nsize: ', p_size, '\n---\n# ', p_brand, '\n') as text from {part}", "part")
    return docs.select("p_partkey", F.inline(F.array(M.frontmatter(F.col("text")))))


@_query("select s_suppkey, case when s_suppkey % 2 = 0 then '<a href=\"https://s.example/' || s_suppkey || '\" title=\"a > b\" rel=\"nofollow\">' else '<a href=\"/s/' || s_suppkey || '\">' end || s_name || '</a>' as html from supplier")
def md_external_links(spark, sf_dir):
    html = """select s_suppkey, case when s_suppkey % 2 = 0 then concat('<a href="https://s.example/', s_suppkey, '" title="a > b">') else concat('<a href="/s/', s_suppkey, '">') end || s_name || '</a>' as html from {supplier}"""
    return _sql(spark, sf_dir, html, "supplier").select("s_suppkey", M.external_links(F.col("html")).alias("html"))


# Blocks.


def _conversations(spark, sf_dir):
    return _sql(spark, sf_dir, f"select conv_id, {_joined('turn', 'text', chr(92) + 'n' + chr(92) + 'n')} as text from {{conversations}} group by conv_id", "conversations")


@_query("select conv_id, count(*) as n_paragraphs from conversations where regexp_matches(text, '[^ \\t\\n]') group by conv_id")
def md_paragraphs(spark, sf_dir):
    tree = R.nodes(_conversations(spark, sf_dir), "conv_id", types=["paragraph"], inline=False)
    return tree.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_paragraphs"))


def _nation_outline(spark, sf_dir):
    return _sql(spark, sf_dir, rf"""
        select n_nationkey, concat('# ', n_name, ' #\n', {_joined('s_suppkey', "concat(s_name, case when s_suppkey % 2 = 0 then '\\n---' else '\\n===' end, '\\n\\ntext\\n')")}) as text
        from {{nation}} join {{supplier}} on n_nationkey = s_nationkey group by n_nationkey, n_name""", "nation", "supplier")


@_query("""select n_nationkey, 1 as depth, n_name as text from nation where n_nationkey in (select s_nationkey from supplier)
    union all select s_nationkey, case when s_suppkey % 2 = 0 then 2 else 1 end, s_name from supplier join nation on n_nationkey = s_nationkey""")
def md_outline(spark, sf_dir):
    tree = R.nodes(_nation_outline(spark, sf_dir), "n_nationkey", types=["heading"])
    return R.outline(tree, "n_nationkey").select("n_nationkey", "depth", "text")


@_query("""select n_nationkey, (row_number() over (partition by n_nationkey order by place))::int as nth, line::int as start_line from (
    select n_nationkey, -1 as place, 1 as line from nation where n_nationkey in (select s_nationkey from supplier)
    union all select s_nationkey, s_suppkey, 5 * row_number() over (partition by s_nationkey order by s_suppkey) - 3 from supplier join nation on n_nationkey = s_nationkey)""")
def md_positions(spark, sf_dir):
    tree = R.nodes(_nation_outline(spark, sf_dir), "n_nationkey", types=["heading"], inline=False, positions=True)
    nth = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("node_id"))
    return tree.select("n_nationkey", nth.alias("nth"), "start_line")


def _segments(spark, sf_dir):
    return _sql(spark, sf_dir, f"select c_nationkey, {_joined('c_custkey', chr(34) + '## The ' + chr(34) + ' || c_mktsegment')} as text from {{customer}} group by c_nationkey", "customer")


@_query("""select c_nationkey, slug || case when n = 0 then '' else '-' || n end as slug from (select c_nationkey, 'the-' || lower(c_mktsegment) as slug,
    row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) - 1 as n from customer)""")
def md_heading_slugs(spark, sf_dir):
    tree = R.nodes(_segments(spark, sf_dir), "c_nationkey", types=["heading"])
    return R.heading_slugs(tree, "c_nationkey").select("c_nationkey", "slug")


@_query("""select c_nationkey, string_agg('<h2 id="the-' || lower(c_mktsegment) || case when n = 0 then '' else '-' || n end || '">The ' || c_mktsegment || '</h2>' || chr(10), '' order by c_custkey) as html
    from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) - 1 as n from customer) group by c_nationkey""")
def md_heading_ids(spark, sf_dir):
    return _segments(spark, sf_dir).select("c_nationkey", M.md_to_html(F.col("text"), Options(heading_ids=True)).alias("html"))


def _order_lists(spark, sf_dir):
    return spread(_sql(spark, sf_dir, rf"select l_orderkey, {_joined('l_linenumber', 'concat(l_linenumber + 4, chr(46), chr(32), l_shipmark, chr(32), l_partkey)'.replace('l_shipmark', 'l_returnflag'))} as text from {{lineitem}} group by l_orderkey", "lineitem"), "l_orderkey")


@_query("select l_orderkey, (min(l_linenumber) + 4)::bigint as start, count(*) as n_items from lineitem group by l_orderkey")
def md_ordered_lists(spark, sf_dir):
    tree = R.nodes(_order_lists(spark, sf_dir), "l_orderkey", types=["list", "listItem"], inline=False)
    return tree.groupBy("l_orderkey").agg(F.max("start").alias("start"), F.count_if(F.col("type") == "listItem").alias("n_items"))


@_query("select o_custkey, o_custkey % 2 = 1 and count(*) > 1 as spread, count(*) as n_items from orders group by o_custkey")
def md_tight_loose(spark, sf_dir):
    docs = _sql(spark, sf_dir, rf"""select o_custkey, if(o_custkey % 2 = 0, text, replace(text, '\n', '\n\n')) as text from
        (select o_custkey, {_joined('o_orderkey', "concat('* order ', o_orderkey)")} as text from {{orders}} group by o_custkey)""", "orders")
    tree = R.nodes(docs, "o_custkey", types=["list", "listItem"], inline=False)
    return tree.groupBy("o_custkey").agg(F.bool_or(F.when(F.col("type") == "list", F.col("spread"))).alias("spread"), F.count_if(F.col("type") == "listItem").alias("n_items"))


@_query("select o_custkey, o_orderstatus = 'F' as checked, 'order ' || o_orderkey || ' of ' || o_orderpriority as text from orders")
def md_task_items(spark, sf_dir):
    docs = _sql(spark, sf_dir, f"""select o_custkey, {_joined('o_orderkey', "concat(if(o_orderstatus = 'F', '- [x] ', '- [ ] '), 'order ', o_orderkey, ' of ', o_orderpriority)")} as text from {{orders}} group by o_custkey""", "orders")
    return R.tasks(R.nodes(docs, "o_custkey", options=Options.gfm(), types=["listItem"]), "o_custkey").select("o_custkey", "checked", "text")


@_query("select event_id, event_type as lang, 'user=' || user_id as meta, props as value from events")
def md_code_blocks(spark, sf_dir):
    docs = _sql(spark, sf_dir, r"select event_id, concat('~~~~ ', event_type, ' user=', user_id, '\n', props, '\n~~~~~\n') as text from {events}", "events")
    return R.code_blocks(R.nodes(spread(docs), "event_id", types=["code"], inline=False), "event_id").select("event_id", "lang", "meta", "value")


@_query("select event_id, props || chr(10) || chr(10) || event_type as value from events")
def md_indented_code(spark, sf_dir):
    docs = _sql(spark, sf_dir, r"select event_id, concat('    ', props, '\n\n\t', event_type, '\n\n') as text from {events}", "events")
    return R.nodes(spread(docs), "event_id", types=["code"], inline=False).select("event_id", "value")


@_query("select r_regionkey, (r_regionkey + 1)::bigint as n_quotes, r_name as text from region")
def md_blockquote_depth(spark, sf_dir):
    docs = _sql(spark, sf_dir, "select r_regionkey, concat(repeat('> ', r_regionkey + 1), r_name) as text from {region}", "region")
    tree = R.nodes(docs, "r_regionkey")
    return tree.groupBy("r_regionkey").agg(F.count_if(F.col("type") == "blockquote").alias("n_quotes"), F.max("value").alias("text"))


@_query("select s_suppkey, (1 + s_suppkey % 3)::bigint as n_rules from supplier")
def md_thematic_breaks(spark, sf_dir):
    docs = _sql(spark, sf_dir, r"select s_suppkey, concat(s_name, '\n\n', repeat('* * *\n', int(1 + s_suppkey % 3))) as text from {supplier}", "supplier")
    tree = R.nodes(docs, "s_suppkey", types=["thematicBreak"], inline=False)
    return tree.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n_rules"))


@_query("select p_partkey, '<div class=\"part\">' || chr(10) || p_name || chr(10) || '</div>' as html, p_brand as text from part")
def md_html_blocks(spark, sf_dir):
    docs = _sql(spark, sf_dir, """select p_partkey, concat('<div class="part">\\n', p_name, '\\n</div>\\n\\n', p_brand) as text from {part}""", "part")
    tree = R.nodes(spread(docs), "p_partkey", types=["html", "text"])
    return tree.groupBy("p_partkey").agg(F.max(F.when(F.col("type") == "html", F.col("value"))).alias("html"), F.max(F.when(F.col("type") == "text", F.col("value"))).alias("text"))


def _nation_table(spark, sf_dir):
    return _sql(spark, sf_dir, rf"""select r_regionkey, concat('| key | nation |\n| --: | :-- |\n', {_joined('n_nationkey', "concat('| ', n_nationkey, ' | ', n_name, ' |')")}) as text
        from {{region}} join {{nation}} on n_regionkey = r_regionkey group by r_regionkey""", "region", "nation")


@_query("""select r_regionkey, "row"::int as "row", "column"::int as "column", align, text from (
    select r_regionkey, 0 as "row", 0 as "column", 'right' as align, 'key' as text from region union all select r_regionkey, 0, 1, 'left', 'nation' from region
    union all select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey), 0, 'right', n_nationkey::varchar from nation
    union all select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey), 1, 'left', n_name from nation)""")
def md_table_cells(spark, sf_dir):
    tree = R.nodes(_nation_table(spark, sf_dir), "r_regionkey", options=Options.gfm(), types=["tableRow"])
    return R.table_cells(tree, "r_regionkey").select("r_regionkey", "row", "column", "align", "text")


@_query("""select n_regionkey as r_regionkey, '<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || '<th align="right">key</th>' || chr(10) || '<th align="left">nation</th>' || chr(10) || '</tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10)
    || string_agg('<tr>' || chr(10) || '<td align="right">' || n_nationkey || '</td>' || chr(10) || '<td align="left">' || n_name || '</td>' || chr(10) || '</tr>' || chr(10), '' order by n_nationkey) || '</tbody>' || chr(10) || '</table>' || chr(10) as html
    from nation group by n_regionkey""")
def md_table_html(spark, sf_dir):
    return _nation_table(spark, sf_dir).select("r_regionkey", M.md_to_html(F.col("text"), Options.gfm()).alias("html"))


# Inlines.


def _one(markdown: str, source: str, key: str):
    def build(spark, sf_dir):
        return spread(_sql(spark, sf_dir, f"select {key}, {markdown} as text from {{{source}}}", source))

    return build


_part_links = _one("""concat('See [', p_name, '](</part/', p_partkey, '> "', p_brand, '") and ![', p_type, '](/img/', p_partkey, '.png)')""", "part", "p_partkey")


@_query("""select p_partkey, 'link' as type, '/part/' || p_partkey as url, p_brand as title from part union all select p_partkey, 'image', '/img/' || p_partkey || '.png', null from part""")
def md_links(spark, sf_dir):
    tree = R.nodes(_part_links(spark, sf_dir), "p_partkey", types=["link", "image"])
    return tree.select("p_partkey", "type", "url", "title")


@_query("select p_partkey, p_type as alt from part")
def md_image_alt(spark, sf_dir):
    return R.nodes(_part_links(spark, sf_dir), "p_partkey", types=["image"]).select("p_partkey", "alt")


def _nation_refs(spark, sf_dir):
    return _sql(spark, sf_dir, rf"""select r_regionkey, concat({_joined('n_nationkey', "concat('[', n_name, '][r', n_nationkey % 2, ']')")}, '\n\n[R0]: /even "', r_name, '"\n[r1]: /odd\n[r0]: /late\n') as text
        from {{region}} join {{nation}} on n_regionkey = r_regionkey group by r_regionkey, r_name""", "region", "nation")


@_query("""select r_regionkey, 'r' || (n_nationkey % 2) as identifier, case when n_nationkey % 2 = 0 then '/even' else '/odd' end as url, case when n_nationkey % 2 = 0 then r_name end as title
    from nation join region on n_regionkey = r_regionkey""")
def md_reference_join(spark, sf_dir):
    tree = R.nodes(_nation_refs(spark, sf_dir), "r_regionkey", types=["linkReference", "definition"])
    return R.resolve_references(tree, "r_regionkey").select("r_regionkey", "identifier", "url", "title")


@_query("""select r_regionkey, 'r0' as identifier, '/even' as url, r_name as title from region where r_regionkey in (select n_regionkey from nation)
    union all select r_regionkey, 'r1', '/odd', null from region where r_regionkey in (select n_regionkey from nation)""")
def md_dup_definitions(spark, sf_dir):
    return R.definitions(R.nodes(_nation_refs(spark, sf_dir), "r_regionkey", types=["definition"]), "r_regionkey")


def _decorated(name: str, open_mark: str, close_mark: str, source: str, column: str, key: str, kind: str, options: Options = Options()):
    """The text between two marks, as a node of some type holds it."""
    @_query(f"select {key}, {column} as text from {source}")
    def build(spark, sf_dir):
        docs = _one(f"concat('a {open_mark}', {column}, '{close_mark} b')", source, key)(spark, sf_dir)
        tree = R.nodes(docs, key, options=options, types=[kind, "text", "inlineCode"])
        if kind == "inlineCode":
            return tree.where("type = 'inlineCode'").select(key, F.col("value").alias("text"))
        held = R.inside(tree, kind, key)
        return held.where("type = 'text'").select(key, F.col("value").alias("text"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("build"), ORACLE_SQL.pop("build")


_decorated("md_emphasis", "*", "*", "part", "p_name", "p_partkey", "emphasis")
_decorated("md_strong", "__", "__", "part", "p_brand", "p_partkey", "strong")
_decorated("md_strike", "~~", "~~", "part", "p_type", "p_partkey", "delete", Options.gfm())
_decorated("md_code_span", "`` ", " ``", "part", "p_brand", "p_partkey", "inlineCode")


@_query("""select c_custkey, 'mailto:c' || c_custkey || '@example.com' as url from customer union all select c_custkey, 'http://www.example.com/c?k=' || c_custkey from customer
    union all select c_custkey, 'https://example.org/' || c_custkey from customer union all select c_custkey, 'ftp://example.net/' || c_custkey from customer""")
def md_autolinks(spark, sf_dir):
    text = "concat('Write to c', c_custkey, '@example.com, see (www.example.com/c?k=', c_custkey, ') or https://example.org/', c_custkey, '. <ftp://example.net/', c_custkey, '>')"
    tree = R.nodes(_one(text, "customer", "c_custkey")(spark, sf_dir), "c_custkey", options=Options.gfm(), types=["link"])
    return tree.select("c_custkey", "url")


@_query("select p_partkey, '<p>&lt;' || p_name || '&gt; &amp; © * ' || p_size || '<br />' || chr(10) || p_type || '</p>' || chr(10) as html from part")
def md_entities(spark, sf_dir):
    text = r"concat('&lt;', p_name, '&#62; &amp; &copy; \\* ', p_size, '  \n', p_type)"
    return _one(text, "part", "p_partkey")(spark, sf_dir).select("p_partkey", M.md_to_html(F.col("text")).alias("html"))


@_query("select s_suppkey, '<p>' || s_name || '<br />' || chr(10) || s_suppkey || '</p>' || chr(10) as html from supplier")
def md_hard_wraps(spark, sf_dir):
    return _one(r"concat(s_name, '\n', s_suppkey)", "supplier", "s_suppkey")(spark, sf_dir).select("s_suppkey", M.md_to_html(F.col("text"), Options(hard_wraps=True)).alias("html"))


# Extensions.


def _notes(spark, sf_dir):
    """A note per order; orders refer to notes of their priority, and one note is never used."""
    return _sql(spark, sf_dir, rf"""select o_custkey, concat({_joined('o_orderkey', "concat('Order ', o_orderkey, '[^', substring(o_orderpriority, 1, 1), ']')", chr(92) + 'n')},
        '\n\n[^1]: one\n[^2]: two\n[^3]: three\n[^4]: four\n[^5]: five\n[^never]: unused\n') as text from {{orders}} group by o_custkey""", "orders")


@_query("""with used as (select o_custkey, o_orderpriority[1:1] as identifier, count(*) as n, min(o_orderkey) as first from orders group by all),
    defs as (select distinct o_custkey, unnest(['1', '2', '3', '4', '5', 'never']) as identifier from orders)
    select d.o_custkey, d.identifier, case when n is not null then row_number() over (partition by d.o_custkey order by first nulls last) end::int as number, n as n_references
    from defs d left join used u on d.o_custkey = u.o_custkey and d.identifier = u.identifier""")
def md_footnotes(spark, sf_dir):
    tree = R.nodes(_notes(spark, sf_dir), "o_custkey", options=FULL, types=["footnoteDefinition", "footnoteReference"])
    return R.footnotes(tree, "o_custkey")


@_query("select p_partkey, p_name as term, p_brand as description, p_partkey % 2 = 1 as spread from part")
def md_deflist(spark, sf_dir):
    docs = _one(r"concat(p_name, if(p_partkey % 2 = 1, '\n', ''), '\n: ', p_brand)", "part", "p_partkey")(spark, sf_dir)
    rows = R.nodes(docs, "p_partkey", options=FULL, types=["defListTerm", "defListDescription"])
    term = F.col("type") == "defListTerm"
    return rows.groupBy("p_partkey").agg(F.max(F.when(term, F.col("text"))).alias("term"), F.max(F.when(~term, F.col("text"))).alias("description"), F.bool_or(F.when(~term, F.col("spread"))).alias("spread"))


@_query("select event_id, event_type as name, 'e' || event_id as id, 'a b' as class, user_id::varchar as user from events")
def md_directives(spark, sf_dir):
    docs = _one(r"concat(':::', event_type, chr(123), '#x .a user=', user_id, ' .b #e', event_id, chr(125), '\ntext\n:::\n')", "events", "event_id")(spark, sf_dir)
    tree = R.nodes(docs, "event_id", options=FULL, types=["containerDirective"], inline=False)
    attributes = F.map_from_entries("attributes")
    return tree.select("event_id", "name", attributes["id"].alias("id"), attributes["class"].alias("class"), attributes["user"].alias("user"))


@_query("select s_suppkey, '<p>' || s_name || case when s_suppkey % 2 = 0 then ' 🚀' else ' 🔥' end || ' :nosuch:</p>' || chr(10) as html from supplier")
def md_emoji(spark, sf_dir):
    docs = _one("concat(s_name, if(s_suppkey % 2 = 0, ' :rocket:', ' :fire:'), ' :nosuch:')", "supplier", "s_suppkey")(spark, sf_dir)
    return docs.select("s_suppkey", M.md_to_html(F.col("text"), Options(emoji=True)).alias("html"))


@_query("""select n_nationkey, '<pre class="mermaid">R' || n_regionkey || ' --&gt; N' || n_nationkey || chr(10) || '</pre>' || chr(10) as html from nation""")
def md_diagram(spark, sf_dir):
    docs = _one(r"concat('```mermaid\nR', n_regionkey, ' --> N', n_nationkey, '\n```')", "nation", "n_nationkey")(spark, sf_dir)
    return docs.select("n_nationkey", M.md_to_html(F.col("text"), Options(diagram=True)).alias("html"))


def _html(name: str, markdown: str, html: str, source: str, key: str, options: Options = Options(), unified: bool = False):
    """HTML of a text written from a row; ``markdown`` is Spark's SQL for it, ``html`` DuckDB's for what must come out."""
    @_query(f"select {key}, {html} as html from {source}")
    def build(spark, sf_dir):
        render = M.md_to_unified_html if unified else M.md_to_html
        return _one(markdown, source, key)(spark, sf_dir).select(key, render(F.col("text"), options).alias("html"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("build"), ORACLE_SQL.pop("build")


def _lines(*parts: str) -> str:
    """DuckDB's SQL for lines; a part in braces is SQL, the rest is text."""
    line = lambda p: " || ".join(x[1:-1] if x.startswith("{") else f"'{x}'" for x in re.split(r"(\{[^}]*\})", p) if x) or "''"
    return " || ".join(f"{line(p)} || chr(10)" for p in parts)


_html("md_footnote_html", r"concat('See[^n] and[^n] ', s_name, '\n\n[^n]: note ', s_suppkey)", _lines(
    '<p>See<sup><a href="#user-content-fn-n" id="user-content-fnref-n" data-footnote-ref aria-describedby="footnote-label">1</a></sup> and<sup><a href="#user-content-fn-n" id="user-content-fnref-n-2" data-footnote-ref aria-describedby="footnote-label">1</a></sup> {s_name}</p>',
    '<section data-footnotes class="footnotes"><h2 class="sr-only" id="footnote-label">Footnotes</h2>', "<ol>", '<li id="user-content-fn-n">',
    '<p>note {s_suppkey} <a href="#user-content-fnref-n" data-footnote-backref="" aria-label="Back to reference 1" class="data-footnote-backref">↩</a> <a href="#user-content-fnref-n-2" data-footnote-backref="" aria-label="Back to reference 1-2" class="data-footnote-backref">↩<sup>2</sup></a></p>',
    "</li>", "</ol>") + " || '</section>'", "supplier", "s_suppkey", FULL)
_html("md_deflist_html", r"concat(p_name, '\n', p_brand, '\n: one\n: *two*\n')", _lines("<dl>", "<dt>{p_name}</dt>", "<dt>{p_brand}</dt>", "<dd>one", "</dd>", "<dd><em>two</em>", "</dd>", "</dl>"), "part", "p_partkey", FULL)
_html("md_deflist_loose_html", r"concat(p_name, '\n\n: ', p_brand, '\n')", _lines("<dl>", "<dt>{p_name}</dt>", "<dd>", "<p>{p_brand}</p>", "</dd>", "</dl>"), "part", "p_partkey", FULL)
_html("md_text_directive", r"concat('a :abbr[', p_name, ']', chr(123), '#i', p_partkey, ' .k', chr(125), ' b')", _lines('<p>a <abbr id="i{p_partkey}" class="k">{p_name}</abbr> b</p>'), "part", "p_partkey", FULL)
_html("md_leaf_directive", r"concat('::video[', p_name, ']', chr(123), '.w src=', p_partkey, chr(125))", _lines('<video class="w" src="{p_partkey}">{p_name}</video>'), "part", "p_partkey", FULL)
_html("md_task_html", r"concat('- [x] ', p_name, '\n- [ ] ', p_brand, '\n- ', p_type)", _lines(
    "<ul>", '<li><input checked="" disabled="" type="checkbox"> {p_name}</li>', '<li><input disabled="" type="checkbox"> {p_brand}</li>', "<li>{p_type}</li>", "</ul>"), "part", "p_partkey", Options.gfm())
_html("md_code_html", r"concat('```c++ x\n<', p_name, '> & \"', p_brand, '\"\n```')", _lines('<pre><code class="language-c++">&lt;{p_name}&gt; &amp; &quot;{p_brand}&quot;', "</code></pre>"), "part", "p_partkey")
_html("md_href_escape", r"concat('[a](</p q/', p_partkey, '?x=\\&y=ä\"> ', chr(39), 'T \"', p_brand, '\" &amp; <', chr(39), ')')",
      _lines('<p><a href="/p%20q/{p_partkey}?x=&amp;y=%C3%A4%22" title="T &quot;{p_brand}&quot; &amp; &lt;">a</a></p>'), "part", "p_partkey")
_html("md_lazy_quote", r"concat('> ', p_name, '\n', p_brand, '\n\n', p_type)", _lines("<blockquote>", "<p>{p_name}", "{p_brand}</p>", "</blockquote>", "<p>{p_type}</p>"), "part", "p_partkey")
_html("md_open_bracket_autolink", r"concat('[www.a.example/', p_partkey, ' b')", _lines("<p>[www.a.example/{p_partkey} b</p>"), "part", "p_partkey", Options.gfm())
_html("md_silent_nodes", r"concat('---\nk: ', p_partkey, '\n---\n[r]: /u\n\n', p_name, '\n\n[^x]: never used')", _lines("<p>{p_name}</p>"), "part", "p_partkey", FULL)
_html("md_tagfilter_html", r"concat('<title>', p_name, '</title> <b>x</b>')", _lines("&lt;title>{p_name}</title> <b>x</b>"), "part", "p_partkey", Options(tagfilter=True))
_html("md_unescape", r"concat('[a](/u\\*', p_partkey, '&ouml; \"', p_brand, ' &copy; \\\"\")')", _lines('<p><a href="/u*{p_partkey}%C3%B6" title="{p_brand} © &quot;">a</a></p>'), "part", "p_partkey")
_html("md_html_block_kinds", r"concat('<!-- ', p_name, '\n\n-->\n\n<?php ', p_partkey, '\n\n?>\n\n<!X\n\n>\n\n<script>\n\n</script>\n\n<x-y>\n*', p_brand, '*\n\n<b>t</b>')", _lines(
    "<!-- {p_name}", "", "-->", "<?php {p_partkey}", "", "?>", "<!X", "", ">", "<script>", "", "</script>", "<x-y>", "*{p_brand}*", "<p><b>t</b></p>"), "part", "p_partkey")
_html("md_nested_emphasis", r"concat('***', p_brand, '** a* **b*c** _d__e_ *f')", _lines("<p><em><strong>{p_brand}</strong> a</em> <strong>b*c</strong> <em>d__e</em> *f</p>"), "part", "p_partkey")
_html("md_unified_escape", r"concat('a & b < ', p_name, ' \"q\"  \n `c\nd` <!-- -->')", "'<p>a &#x26; b &#x3C; ' || p_name || ' \"q\"<br>' || chr(10) || '<code>c d</code> </p>'", "part", "p_partkey", unified=True)
_html("md_unified_links", r"concat('[t](/a%20b&c ', chr(39), 'x\"y', chr(39), ') ![*i*](/ü) [r]\n\n[r]: /first\n[r]: /second\n', p_partkey)", """'<p><a href="/a%20b&#x26;c" title="x&#x22;y">t</a> <img src="/%C3%BC" alt="i"> <a href="/first">r</a></p>' || chr(10) || '<p>' || p_partkey || '</p>'""", "part", "p_partkey", unified=True)
_html("md_unified_lists", r"concat('3. ', p_name, '\n\n   more\n4. x\n\n- a\n  - ', p_brand, '\n\n```py\nx\n```')", """'<ol start="3">' || chr(10) || '<li>' || chr(10) || '<p>' || p_name || '</p>' || chr(10) || '<p>more</p>' || chr(10) || '</li>' || chr(10) || '<li>' || chr(10) || '<p>x</p>' || chr(10) || '</li>' || chr(10) || '</ol>' || chr(10)
    || '<ul>' || chr(10) || '<li>a' || chr(10) || '<ul>' || chr(10) || '<li>' || p_brand || '</li>' || chr(10) || '</ul>' || chr(10) || '</li>' || chr(10) || '</ul>' || chr(10) || '<pre><code class="language-py">x' || chr(10) || '</code></pre>'""", "part", "p_partkey", unified=True)


def _note_element(kind: str, attributes: dict):
    """Directives become asides, and headings get a class, as a plug-in would do it."""
    if kind == "leafDirective":
        return "aside", dict(attributes["attributes"]) | {"data-name": attributes["name"]}
    return (None, {"class": "title"}) if kind == "heading" else None


@_query("""select p_partkey, '<h2 class="title">' || p_brand || '</h2>' || chr(10) || '<aside id="n' || p_partkey || '" data-name="note">see <em>' || p_name || '</em></aside>' as html from part""")
def md_unified_elements(spark, sf_dir):
    """Tags and attributes that a plug-in gives to nodes."""
    docs = _one(r"concat('## ', p_brand, '\n\n::note[see *', p_name, '*]', chr(123), '#n', p_partkey, chr(125))", "part", "p_partkey")(spark, sf_dir)
    return docs.select("p_partkey", M.md_to_unified_html(F.col("text"), FULL, _note_element).alias("html"))


@_query("select count(*)::bigint as documents, coalesce(sum(length(text)), 0)::bigint as characters, true as timed from documents where text is not null")
def md_phase_profile(spark, sf_dir):
    """What was measured; the seconds themselves differ from run to run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return R.phase_profile(docs).select("documents", "characters", ((F.col("blocks") >= 0) & (F.col("tree") > 0) & (F.col("html") > 0)).alias("timed"))


@_query("""select p_partkey, x.type as type, x.l1::int as start_line, x.c1::int as start_column, x.o1::int as start_offset, x.l2::int as end_line, x.c2::int as end_column, x.o2::int as end_offset from (
    select p_partkey, unnest([
      {'type': 'root', 'l1': 1, 'c1': 1, 'o1': 0, 'l2': 3, 'c2': n + 9, 'o2': n + 17},
      {'type': 'heading', 'l1': 1, 'c1': 1, 'o1': 0, 'l2': 1, 'c2': 8, 'o2': 7},
      {'type': 'text', 'l1': 1, 'c1': 3, 'o1': 2, 'l2': 1, 'c2': 6, 'o2': 5},
      {'type': 'paragraph', 'l1': 3, 'c1': 1, 'o1': 9, 'l2': 3, 'c2': n + 9, 'o2': n + 17},
      {'type': 'text', 'l1': 3, 'c1': 1, 'o1': 9, 'l2': 3, 'c2': 4, 'o2': 12},
      {'type': 'emphasis', 'l1': 3, 'c1': 4, 'o1': 12, 'l2': 3, 'c2': n + 6, 'o2': n + 14},
      {'type': 'text', 'l1': 3, 'c1': 5, 'o1': 13, 'l2': 3, 'c2': n + 5, 'o2': n + 13},
      {'type': 'text', 'l1': 3, 'c1': n + 6, 'o1': n + 14, 'l2': 3, 'c2': n + 9, 'o2': n + 17}]) as x from (select p_partkey, length(p_name) as n from part))""")
def md_points(spark, sf_dir):
    """Lines, columns and offsets of all nodes, in UTF-16 units (the emoji are two); blanks after a heading's text belong to the heading alone."""
    docs = _one(r"concat('# 😀x  \n\n😀 *', p_name, '* 😀')", "part", "p_partkey")(spark, sf_dir)
    return R.nodes(docs, "p_partkey", positions=True).select("p_partkey", "type", "start_line", "start_column", "start_offset", "end_line", "end_column", "end_offset")


@_query("select p_partkey, 'yaml' as type, 'k: ' || p_name as value from part union all select p_partkey, 'heading', null from part union all select p_partkey, 'text', p_brand from part union all select p_partkey, 'root', null from part")
def md_frontmatter_nodes(spark, sf_dir):
    docs = _one(r"concat('---\nk: ', p_name, '\n---\n# ', p_brand)", "part", "p_partkey")(spark, sf_dir)
    return R.nodes(docs, "p_partkey", options=FULL).select("p_partkey", "type", "value")


@_query("""select o_custkey, o_orderpriority[1:1] as identifier from orders group by all""")
def md_used_footnotes(spark, sf_dir):
    tree = R.nodes(_notes(spark, sf_dir), "o_custkey", options=FULL, types=["footnoteDefinition", "footnoteReference"])
    return R.used_footnotes(tree, "o_custkey")


@_query("""select p_partkey, s.r::int as "row", s.c::int as "column", s.x as text from (select p_partkey, unnest([
    {'r': 0, 'c': 0, 'x': 'a'}, {'r': 0, 'c': 1, 'x': p_brand}, {'r': 1, 'c': 0, 'x': p_name}, {'r': 1, 'c': 1, 'x': ''}, {'r': 2, 'c': 0, 'x': '1'}, {'r': 2, 'c': 1, 'x': 'b|c'}]) as s from part)""")
def md_ragged_table(spark, sf_dir):
    """A short row is padded, a long one is cut."""
    docs = _one(r"concat('| a | ', p_brand, ' |\n|-|-|\n| ', p_name, '\n| 1 | b\\|c | 3 |')", "part", "p_partkey")(spark, sf_dir)
    tree = R.nodes(docs, "p_partkey", options=Options.gfm(), types=["tableRow"])
    return R.table_cells(tree, "p_partkey").select("p_partkey", "row", "column", "text")


@_query("""select p_partkey, '/direct' as url from part union all select p_partkey, '/first' from part union all select p_partkey, '/i.png' from part""")
def md_all_links(spark, sf_dir):
    docs = _one(r"concat('[a](/direct) [r] ![i](/i.png) [none]\n\n[r]: /first\n[r]: /second\n\n', p_name)", "part", "p_partkey")(spark, sf_dir)
    tree = R.nodes(docs, "p_partkey", types=["link", "image", "linkReference", "imageReference", "definition"])
    return R.links(tree, "p_partkey").select("p_partkey", "url")


@_query("""select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+')) as address from documents""")
def md_mail_candidates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(M.mail_candidates(F.col("text"))).alias("address"))


@_query("""select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+')) as address from documents""")
def md_email_autolink(spark, sf_dir):
    """Mail links of all documents; only those with a candidate are parsed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.size(M.mail_candidates(F.col("text"))) > 0)
    found = R.nodes(docs, options=Options.gfm(), types=["link"]).where(F.startswith("url", F.lit("mailto:")))
    return found.select("doc_id", F.substring("url", len("mailto:") + 1, 1 << 30).alias("address"))


@_query("""select page_id, replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') as text from pages""")
def md_page_references(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.decoded(F.col("html")).alias("text"))


@_query("""select page_id, string_split(html, chr(10))[1] as value from pages where starts_with(html, '<!DOCTYPE')""")
def md_page_html_blocks(spark, sf_dir):
    """The declaration that a page begins with, as a block (it ends with the line)."""
    tree = R.nodes(table(spark, sf_dir, "pages"), "page_id", "html", types=["html"], inline=False)
    return tree.where("depth_in_tree = 1 and ordinal = 0 and startswith(value, '<!')").select("page_id", "value")


@_query("""select p_partkey, x.type as type, x.line::int as start_line, x.value as value from (select p_partkey, unnest([
    {'type': 'root', 'line': 1, 'value': null}, {'type': 'heading', 'line': 1, 'value': null}, {'type': 'list', 'line': 3, 'value': null}, {'type': 'listItem', 'line': 3, 'value': null},
    {'type': 'paragraph', 'line': 3, 'value': null}, {'type': 'code', 'line': 5, 'value': p_type}]) as x from part)""")
def md_table_function(spark, sf_dir):
    """Blocks by the table function of a table, in Arrow batches."""
    spark.udtf.register("md_part_blocks", M.blocks_table_function("p_partkey bigint"))
    text = r"concat('# ', p_name, '\n\n- ', p_brand, '\n\n```\n', p_type, '\n```')"
    docs = _one(text, "part", "p_partkey")(spark, sf_dir)
    return spark.sql("select p_partkey, type, start_line, value from md_part_blocks(table({docs}))", docs=docs)


_CRLF = _one(r"concat('# ', p_name, '\r\n', p_brand, '\r\r\n', p_type)", "part", "p_partkey")


@_query("""select p_partkey, '<h1>' || p_name || '</h1>' || chr(10) || '<p>' || p_brand || '</p>' || chr(10) || '<p>' || p_type || '</p>' || chr(10) as html from part""")
def md_normalized_lines(spark, sf_dir):
    return _CRLF(spark, sf_dir).select("p_partkey", M.md_to_html(M.normalize_newlines(F.col("text"))).alias("html"))


@_query("""select p_partkey, lower(p_brand) as label, 'c++' as lang, 'a b' as meta, 'x' || chr(10) || 'y' as trimmed, '&#x26;&#x3C;"' as shown, '&#x26;<&#x22;' as attribute from part""")
def md_native_helpers(spark, sf_dir):
    docs = table(spark, sf_dir, "part")
    info, mark = F.lit("  c++ \ta b"), F.lit('&<"')
    return docs.select("p_partkey", M.label_key(F.concat(F.lit(" \n"), F.col("p_brand"), F.lit("\t "))).alias("label"), M.code_language(info).alias("lang"), M.code_meta(info).alias("meta"),
                       M.trim_lines(F.lit("x \t\n  y")).alias("trimmed"), M.escape_unified_text(mark).alias("shown"), M.escape_unified_attribute(mark).alias("attribute"))


# Sinks and whole documents.

_part_page = _one(r"concat('# ', p_name, '\n\n*', p_brand, '* of **size ', p_size, '**\n\n1. ', p_type, '\n2. <b>x</b>\n')", "part", "p_partkey")


@_query("""select p_partkey, '<h1>' || p_name || '</h1>' || chr(10) || '<p><em>' || p_brand || '</em> of <strong>size ' || p_size || '</strong></p>' || chr(10) || '<ol>' || chr(10) || '<li>' || p_type || '</li>' || chr(10) || '<li><b>x</b></li>' || chr(10) || '</ol>' || chr(10) as html from part""")
def md_html_roundtrip(spark, sf_dir):
    return _part_page(spark, sf_dir).select("p_partkey", M.md_to_html(F.col("text")).alias("html"))


@_query("""select p_partkey, '<h1>' || p_name || '</h1>' || chr(10) || '<p><em>' || p_brand || '</em> of <strong>size ' || p_size || '</strong></p>' || chr(10) || '<ol>' || chr(10) || '<li>' || p_type || '</li>' || chr(10) || '<li>x</li>' || chr(10) || '</ol>' as html from part""")
def md_unified_html(spark, sf_dir):
    return _part_page(spark, sf_dir).select("p_partkey", M.md_to_unified_html(F.col("text")).alias("html"))


@_query("""select s_suppkey, '{"type":"root","children":[{"type":"heading","depth":2,"children":[{"type":"text","value":"' || s_name || '"}]}]}' as json from supplier""")
def md_json(spark, sf_dir):
    return _one("concat('## ', s_name)", "supplier", "s_suppkey")(spark, sf_dir).select("s_suppkey", M.md_to_json(F.col("text")).alias("json"))


@_query("select l_orderkey, (2 + 3 * count(*))::bigint as n_nodes from lineitem group by l_orderkey")
def md_node_count(spark, sf_dir):
    """A root, a list, and an item, a paragraph and a text for each line of an order."""
    return R.node_counts(R.nodes(_order_lists(spark, sf_dir), "l_orderkey"), "l_orderkey")


@_query()
def md_render_documents(spark, sf_dir):
    """The HTML of all documents; a test holds the plain route against the kernel."""
    return R.render_html(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query("""select doc_id, length(text)::bigint as n_chars, case when regexp_matches(text, '(^|\\n)[ \\t]*([#>~+=*_|-]|[0-9]{1,9}[.)])|(^|\\n)( {4}| {0,3}\\t)|  (\\n|$)|[`\\[]|[*_][^ \\t\\n*_]|&[#A-Za-z]|<[A-Za-z/!?]|\\\\[!-/:-@\\[-`{-~\\n]')
    then length(text) else 0 end::bigint as kernel_chars from documents""")
def md_routing(spark, sf_dir):
    """What of each document goes to Python; no document has a blank line, so each goes whole or not at all."""
    return R.routing(table(spark, sf_dir, "documents"))


@_query("""select p_partkey, '<p>' || p_name || ' &amp; more</p>' || chr(10) || '<ul>' || chr(10) || '<li>' || chr(10) || '<p>' || p_brand || '</p>' || chr(10) || '<p>still</p>' || chr(10) || '</li>' || chr(10) || '</ul>' || chr(10)
    || '<p>2024 ' || p_type || chr(10) || 'in two lines!</p>' || chr(10) || '<h2>' || p_size || '</h2>' || chr(10) as html, (length(p_brand) + length(p_size::varchar) + 17)::bigint as kernel_chars from part""")
def md_routed_parts(spark, sf_dir):
    """Plain parts beside marked ones: only a list and a heading go to the kernel."""
    docs = _one(r"concat(p_name, ' & more\n\n- ', p_brand, '\n\n  still\n\n\n2024 ', p_type, '\nin two lines!\n\n## ', p_size)", "part", "p_partkey")(spark, sf_dir)
    return R.render_html(docs, "p_partkey").join(R.routing(docs, "p_partkey").select("p_partkey", "kernel_chars"), "p_partkey")


@_query("""select s_suppkey, 'ασ ' || lower(s_name) || ' ss' as label from supplier""")
def md_label_keys(spark, sf_dir):
    """Labels as references compare them: no rule for a word's last sigma, any white space, sharp s in both cases."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", M.label_key(F.concat(F.lit(" ΑΣ\u00a0\n"), F.col("s_name"), F.lit("\t ẞ "))).alias("label"))


@_query()
def md_node_types(spark, sf_dir):
    """Nodes by language and type, with totals (rollup), under all extensions."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), "text"))
    return R.nodes(docs, "language", options=FULL).rollup("language", "type").agg(F.count(F.lit(1)).alias("n_nodes"))


@_query("""select quality, count(*) as n_docs, count(*) filter (where text <> '') as n_paragraphs from (select l.quality, trim(d.text, ' ' || chr(9) || chr(10)) as text from documents d join labels l on d.doc_id = l.doc_id) group by quality""")
def md_quality_join(spark, sf_dir):
    """Paragraphs by quality label; no document has a blank line, so each is one paragraph."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    tree = R.nodes(spread(docs), types=["root", "paragraph"], inline=False)
    counts = tree.groupBy("doc_id").agg(F.count_if(F.col("type") == "paragraph").alias("n"))
    return counts.join(labels, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_paragraphs"))


@_query("select l_orderkey, count(*) as n_items from lineitem group by l_orderkey order by n_items desc, l_orderkey limit 20")
def md_topk_docs(spark, sf_dir):
    """The 20 orders whose lists have the most items."""
    tree = R.nodes(_order_lists(spark, sf_dir), "l_orderkey", types=["listItem"], inline=False)
    return tree.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_items")).orderBy(F.desc("n_items"), "l_orderkey").limit(20)
