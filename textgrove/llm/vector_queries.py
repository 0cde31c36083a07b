"""Problems 3 and 5 on chunks.vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .density import CONFIG, density_clusters, linked_clusters, reachability_forest
from .reference_sql import P3_FOUND, P3_RECALL, P5_FOUND, P5_RECALL
from .vector_tree import VectorIndex, expected_links, neighbours, recall_of, recall_row, similar_pairs


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return similar_pairs(table(spark, root, "chunks"), "chunk_id", "vector", k=5, floor=0.8, newest="ingested_at").selectExpr("a AS chunk_a", "b AS chunk_b")


def _asked(index: VectorIndex) -> DataFrame:
    """Every chunk whose number (its id read as hexadecimal) is divisible by 100."""
    number = F.conv(F.substring("id", 2, 15), 16, 10).cast("decimal(20,0)")
    return index.ids.where(number % 100 == 0).select("vid")


def p3_recall(spark: SparkSession, root: str) -> DataFrame:
    """Measured recall of the index: the five best links of the chunks asked, by a scan of all vectors."""
    index = VectorIndex(table(spark, root, "chunks"), "chunk_id", "vector", 128, 0.8, k=5, newest="ingested_at")
    return recall_of(index, neighbours(index), _asked(index))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return linked_clusters(table(spark, root, "chunks"), "chunk_id", "vector", floor=0.75, least=3, newest="ingested_at").selectExpr("cluster_key", "id AS chunk_id")


def p5_recall(spark: SparkSession, root: str) -> DataFrame:
    """Measured recall of the clusters: the five weakest links at or above the floor of the chunks asked, by a scan of all vectors, met if both ends are in one part."""
    index = VectorIndex(table(spark, root, "chunks"), "chunk_id", "vector", 128, 0.75, CONFIG, k=5, weakest=True, newest="ingested_at")
    if not index.rows:
        return recall_row(spark.createDataFrame([], "vid bigint, hit int"), 0)
    _, parts = reachability_forest(index, 0.75)
    expected, n = expected_links(index, _asked(index))
    ends = expected.join(parts.toDF("vid", "p"), "vid", "left").join(parts.toDF("other", "q"), "other", "left")
    return recall_row(ends.withColumn("hit", F.when(F.col("p") == F.col("q"), 1)), n)


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    """(cluster_key, size, place, chunk_id, summary): each stable cluster's most typical members with their summaries."""
    chunks = table(spark, root, "chunks")
    found = density_clusters(chunks, "chunk_id", "vector", newest="ingested_at").where("place is not null")
    told = chunks.groupBy("chunk_id").agg(F.max("summary").alias("summary"))
    return found.join(told, found["id"] == told["chunk_id"]).select("cluster_key", "size", "place", "chunk_id", "summary")


QUERIES = {"p3_found": p3_found, "p3_recall": p3_recall, "p5_found": p5_found, "p5_recall": p5_recall, "p5_clusters": p5_clusters}
SQL = {"p3_found": P3_FOUND, "p3_recall": P3_RECALL, "p5_found": P5_FOUND, "p5_recall": P5_RECALL}
