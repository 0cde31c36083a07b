"""Problem 4: covered stretches and gaps of the leaf spans of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import covered_gaps, covered_periods
from ..sources.tables import leaf_rows, read_right_way, table


def leaf_spans(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, s, e) of every leaf row; a missing file_path is that of the contract."""
    s, e = read_right_way()
    leaves = leaf_rows(table(spark, root, "chunks"), "doc_id", "file_path", "span").select("doc_id", "file_path", s.alias("s"), e.alias("e")).where("s < e")
    files = table(spark, root, "contracts").where("doc_id is not null and file_path is not null").groupBy("doc_id").agg(F.min("file_path").alias("contract_path"))
    lost = leaves.where("file_path is null").join(files, "doc_id").select(F.col("contract_path").alias("file_path"), "s", "e")
    return leaves.where("file_path is not null").select("file_path", "s", "e").unionByName(lost)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return covered_gaps(leaf_spans(spark, root), "file_path", "s", "e")


def p4_periods(spark: SparkSession, root: str) -> DataFrame:
    return covered_periods(leaf_spans(spark, root), "file_path", "s", "e")


_LEAVES = """
WITH RECURSIVE leaf AS (
  SELECT coalesce(k.file_path, c.file_path) AS file_path,
         least(k.span."start", k.span."end")::BIGINT AS s, greatest(k.span."start", k.span."end")::BIGINT AS e
  FROM chunks k LEFT JOIN (SELECT doc_id, min(file_path) AS file_path FROM contracts GROUP BY doc_id) c USING (doc_id)
  WHERE NOT EXISTS (SELECT 1 FROM chunks p WHERE p.parent_id = k.chunk_id)
    AND k.span."start" IS NOT NULL AND k.span."end" IS NOT NULL),
kept AS (SELECT * FROM leaf WHERE s < e AND file_path IS NOT NULL),
marked AS (SELECT *, max(e) OVER (PARTITION BY file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kept)
"""

QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods}
SQL = {
    "p4_found": _LEAVES + "SELECT file_path, before AS gap_start, s AS gap_end FROM marked WHERE s > before",
    "p4_periods": _LEAVES
    + """, runs AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT file_path, min(s) AS period_start, max(e) AS period_end FROM runs GROUP BY file_path, run""",
}
