"""Markdown files in, rendered documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .datasource import MarkdownDataSource, register_source

__all__ = ["MarkdownDataSource", "read_markdown", "register_source", "write_json"]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (a hash of the path), ``path``, ``text``: one row per file; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_json(tree: DataFrame, path: str, column: str = "json") -> None:
    """One document's tree per line."""
    tree.select(column).write.text(path)
