"""Problems 6 and 7 on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .leakage import leaked_items, leaked_spans, without_leaks
from .packing import CAPACITY, byte_tokens, pack
from .reference_sql import P6_CHECKS, P7_FOUND, P7_ITEMS


def _packed(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", byte_tokens("text").alias("tokens"))
    return pack(documents, "doc_id", "tokens", CAPACITY)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that the packing had to cut."""
    return _packed(spark, root).where("piece = 1").select(F.col("id").alias("doc_id")).distinct()


def p6_packing(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root).select(F.col("id").alias("doc_id"), "piece", "size", "container")


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    """One row: containers used, the bound by total size, and the part of all room that stays unused."""
    total = _packed(spark, root).agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
    return total.select("containers", F.ceil(F.col("tokens") / CAPACITY).alias("least"), (1 - F.col("tokens") / (F.col("containers") * CAPACITY)).alias("unused"))


def p6_checks(spark: SparkSession, root: str) -> DataFrame:
    """What the packing must keep: every document and token, no container over its capacity, no cut of a text that fits."""
    packed = cut(_packed(spark, root), "packing")
    whole = packed.agg(F.countDistinct("id").alias("documents"), F.sum("size").alias("tokens"), F.count_if((F.col("pieces") > 1) & (F.col("size") < CAPACITY) & (F.col("piece") < F.col("pieces") - 1)).alias("cut"))
    over = packed.groupBy("container").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("over"))
    names = {"documents": "documents", "tokens": "tokens", "over capacity": "over", "cut without need": "cut"}
    rows = F.array(*[F.struct(F.lit(k).alias("what"), F.col(v).cast("bigint").alias("n")) for k, v in names.items()])
    return whole.crossJoin(over).select(F.explode(rows).alias("r")).select("r.*")  # one row each


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"), least=12)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id")


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    """Per item the documents that hold a run of it, and those that hold at least half of its words."""
    half = F.col("covered") * 2 >= F.col("item_words")
    return _leaks(spark, root).groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(half).alias("half_or_more"), F.max("longest").alias("longest"))


def p7_spans(spark: SparkSession, root: str) -> DataFrame:
    """The stretches to be removed: at least 12 words long, or at least 80 % of an item of six words or more."""
    spans = leaked_spans(table(spark, root, "documents"), table(spark, root, "eval_items"), least=12, coverage=0.8)
    return spans.select("doc_id", "item_id", "span_start", "span_end", "words")


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text without those stretches, as its hash, and how much was removed."""
    return without_leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", F.md5("text").alias("text"), "removed")


QUERIES = {"p6_found": p6_found, "p6_packing": p6_packing, "p6_fill": p6_fill, "p6_checks": p6_checks, "p7_found": p7_found, "p7_items": p7_items, "p7_spans": p7_spans, "p7_cleaned": p7_cleaned}
SQL = {
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 8192",
    "p6_checks": P6_CHECKS,
    "p7_found": P7_FOUND,
    "p7_items": P7_ITEMS,
}
