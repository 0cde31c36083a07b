"""Problem 1: leaves of chunks, and contracts without chunks, that are longer than 1,200."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import leaf_rows, read_right_way, table
from .reference_sql import P1_CHECKS, P1_FOUND
from .split import split_oversized

LIMIT, OVERLAP = 1_200, 120


def long_items(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, text, offset): each long leaf once, cut from its contract's content, and each long contract without chunks once.

    Of a doc_id or chunk_id delivered repeatedly the latest row counts. A leaf with a null or empty span has no place and
    is left out; a span beyond the content is clipped.
    """
    chunks, contracts = table(spark, root, "chunks"), table(spark, root, "contracts")
    s, e = read_right_way()
    at = F.struct("ingested_at", F.col("s"), F.col("e"), "doc_id")
    leaves = leaf_rows(chunks, "doc_id", "span", "ingested_at").select("chunk_id", "doc_id", "ingested_at", s.alias("s"), e.alias("e")).where(F.col("e") - F.col("s") > LIMIT)
    leaves = leaves.groupBy("chunk_id").agg(F.max(at).alias("m")).select("chunk_id", "m.doc_id", "m.s", "m.e")
    # the whole-text side is shuffled once, reduced to a row a doc_id, and serves both joins from that partitioning
    texts = contracts.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("ingested_at", F.coalesce("file_offset", F.lit(0)).cast("bigint").alias("o"), F.coalesce("content", F.lit("")).alias("t"))).alias("m")).select("doc_id", "m.o", "m.t")
    cut = leaves.join(texts, "doc_id").select(
        F.col("chunk_id").alias("item_id"),
        F.substring("t", F.greatest(F.col("s") - F.col("o"), F.lit(0)).cast("int") + 1, (F.col("e") - F.greatest("s", "o")).cast("int")).alias("text"),
        F.greatest("s", "o").alias("offset"),
    )
    bare = texts.join(chunks.select("doc_id").where("doc_id is not null"), "doc_id", "left_anti").select(F.col("doc_id").alias("item_id"), F.col("t").alias("text"), F.col("o").alias("offset"))
    return cut.unionByName(bare)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return split_oversized(long_items(spark, root), limit=LIMIT, overlap=OVERLAP, method="sequential")


def p1_balanced(spark: SparkSession, root: str) -> DataFrame:
    return split_oversized(long_items(spark, root), limit=LIMIT, overlap=OVERLAP, method="balanced")


def p1_checks(spark: SparkSession, root: str) -> DataFrame:
    """What the balanced pieces must keep: the items, all their text, and no piece over the limit or with another overlap."""
    pieces = p1_balanced(spark, root)
    by = Window.partitionBy("item_id").orderBy("piece_start")
    seen = pieces.withColumn("before", F.lag("piece_end").over(by))
    size = F.col("piece_end") - F.col("piece_start")
    per = seen.groupBy("item_id").agg(F.sum(size - F.when(F.col("before").isNull(), 0).otherwise(OVERLAP)).alias("n"), F.count_if(size > LIMIT).alias("over"), F.count_if(F.col("before") - F.col("piece_start") != OVERLAP).alias("lap"), (F.max("piece_end") - F.min("piece_start")).alias("extent"))
    total = per.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.coalesce(F.sum("over"), F.lit(0)).alias("over"), F.coalesce(F.sum("lap"), F.lit(0)).alias("lap"), F.count_if(F.col("n") != F.col("extent")).alias("short"))
    names = {"items": "items", "code points": "points", "over the limit": "over", "wrong overlap": "lap", "items short": "short"}
    return total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.col(v).cast("bigint").alias("n")) for k, v in names.items()])).alias("r")).select("r.*")


QUERIES = {"p1_found": p1_found, "p1_balanced": p1_balanced, "p1_checks": p1_checks}
SQL = {"p1_found": P1_FOUND, "p1_checks": P1_CHECKS}
