"""The kernel on streams: it keeps no state, so a stream of documents is parsed like a table; state is for revisions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nodes
from ..options import Options
from .replay import replay
from .revisions import revision_changes

__all__ = ["read_documents", "replay", "revision_changes", "stream_nodes", "windowed_counts"]


def read_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text", options: Options = Options(), **choice) -> DataFrame:
    return nodes(docs, key, text, options, **choice)


def windowed_counts(docs: DataFrame, time: str, text: str = "text", width: str = "1 hour", late: str = "10 minutes", options: Options = Options()) -> DataFrame:
    """Nodes by type in tumbling windows of event time; documents later than ``late`` are left out."""
    from ..functions import md_nodes_array

    tree = F.explode(md_nodes_array(F.col(text), options)).alias("_n")
    rows = docs.withWatermark(time, late).select(time, tree)
    return rows.groupBy(F.window(time, width), F.col("_n.type").alias("type")).agg(F.count(F.lit(1)).alias("n_nodes"))
