"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def leaf_rows(chunks: DataFrame, *columns: str) -> DataFrame:
    """Rows of chunks that no row names as its parent; is_leaf is not trusted, as it may be null.

    A row with a null chunk_id can have no child and is a leaf. Redelivered rows stay; callers that need one row per
    chunk_id reduce them.
    """
    parents = chunks.select(F.col("parent_id").alias("__parent")).where("__parent is not null").distinct()
    rows = chunks.select("chunk_id", *[c for c in columns if c != "chunk_id"])
    return rows.join(parents, rows["chunk_id"] == parents["__parent"], "left_anti")


def read_right_way(span: str = "span"):
    """(start, end) of a span column, backwards spans turned round; null if either end is."""
    s, e = F.col(f"{span}.start"), F.col(f"{span}.end")
    known = s.isNotNull() & e.isNotNull()
    return F.when(known, F.least(s, e)).cast("bigint"), F.when(known, F.greatest(s, e)).cast("bigint")
