"""Problem 2: passages of contracts.content that stand in other contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .reference_sql import P2_AMOUNT, P2_FOUND
from .shared_spans import shared_spans


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans(table(spark, root, "contracts"), "doc_id", "content", 200).select(F.col("id").alias("doc_id"), "span_start", "span_end")


def p2_amount(spark: SparkSession, root: str) -> DataFrame:
    """Per record with shared stretches: their number, the shared code points and their part of the text."""
    spans = shared_spans(table(spark, root, "contracts"), "doc_id", "content", 200)
    amount = F.sum(F.col("span_end") - F.col("span_start"))
    return spans.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("stretches"), amount.alias("shared"), (amount / F.max("length")).alias("part"))


QUERIES = {"p2_found": p2_found, "p2_amount": p2_amount}
SQL = {"p2_found": P2_FOUND, "p2_amount": P2_AMOUNT}
