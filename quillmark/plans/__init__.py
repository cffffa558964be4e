"""Queries over the driver's tables, each with SQL that gives the same rows without parsing anything."""

from . import corpus_queries, tree_queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus_queries", "tree_queries"]
