"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Null, empty and blank texts go in the first stage (too short); repeated rows
and copies in the second; texts of any length are read whole; an empty table goes through as one; columns beside
those of ``documents`` pass through all stages, but for ``shard`` and ``slot``, which the last one replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontamination, mixing, near_duplicates, quality_rules, sharding
from quillmark.llm.common import Scratch

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_duplicates", near_duplicates.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]
#: SQL can't express near duplicates, edit matching or the splitters; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; each one's rows are written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
