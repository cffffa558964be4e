"""Corpora over time: sketches stored by group and merged, and a stream of revisions with state by document."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from .. import operators as R
from ..streaming import read_documents, replay, revision_changes
from .queries import _query, _sql, spread


@_query("""select p_brand, type, count(*) as n_nodes, count(v) as n_values, count(distinct v) as n_distinct, coalesce((max(n) filter (v is not null))::bigint, 0) as most_often from (
    select p_brand, type, v, count(*) over (partition by p_brand, type, v) as n from (
      select p_brand, unnest(['root', 'heading', 'text', 'thematicBreak', 'link']) as type, unnest([null, p_type, p_type, null, '/size/' || p_size]) as v from part
      union all select p_brand, 'paragraph', p_name from part union all select p_brand, 'text', p_name from part)) group by p_brand, type""")
def md_merged_sketches(spark, sf_dir):
    """Sketches of the nodes of each brand and size, merged to brands: few enough values that distinct and frequency sketches are exact."""
    docs = _sql(spark, sf_dir, r"select p_brand, p_size, concat('# ', p_type, '\n\n[', p_name, '](/size/', p_size, ')\n\n---\n') as text from {part}", "part")
    tree = R.nodes(spread(docs.select(F.struct("p_brand", "p_size").alias("_k"), "text")), "_k").select("_k.*", "type", "url", "text", "value")
    told = R.estimates(R.merge_sketches(R.sketch_nodes(tree, ["p_brand", "p_size"]), ["p_brand"]), top=1)
    most = F.coalesce(F.element_at(F.transform("most_frequent", lambda m: m["count"]), 1), F.lit(0).cast("long"))
    return told.select("p_brand", "type", "n_nodes", "n_values", "n_distinct", F.when(F.col("n_values") > 0, most).otherwise(0).alias("most_often"))


@_query("""select o_custkey, type, sum(n)::bigint as n_nodes from (
    select o_custkey, unnest(['root', 'heading', 'text', 'list', 'listItem', 'paragraph', 'text']) as type, unnest([1, 1, 1, (k > 0)::int, k, k, k]) as n from (
      select o_custkey, (o_orderkey % 4)::int as k, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1)
    group by o_custkey, type having sum(n) > 0""")
def md_latest_revisions(spark, sf_dir):
    """Each customer's orders as revisions of one document, from a stream in any order: the changes sum to the nodes of the latest."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stream = read_documents(spark, f"{sf_dir}/orders.parque[t]", orders.schema)  # as a pattern the table may be one file or a folder
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    docs = stream.select("o_custkey", at.alias("at"), F.expr(r"concat('# ', o_orderpriority, '\n\n', repeat(concat('- ', o_orderstatus, '\n'), cast(o_orderkey % 4 as int)))").alias("text"))
    changes = replay(revision_changes(docs, "o_custkey", "at", expire=timedelta(days=36_500)))
    return changes.groupBy("o_custkey", "type").agg(F.sum(F.col("added") - F.col("removed")).alias("n_nodes")).where("n_nodes > 0")
