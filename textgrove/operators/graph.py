"""The property graph as two tables: nodes (Corpus and Chunk) and edges (CHILD, NEXT, PREV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Embedder, embed
from ..functions.text import basename, trimmed
from ..sources.tables import read_right_way
from .tree import ordered


NODE = "id string, label string, name string, file_path string, toc_json string, content string, summary string, span array<int>, ord int, depth int, leaf boolean, vector array<float>"


def _column(df: DataFrame, kind: str, *names: str) -> Column:
    """The first of the columns that df has, else null."""
    at = next((F.col(n) for n in names if n in df.columns), F.lit(None))
    return at.cast(kind)


def _span(df: DataFrame) -> Column:
    name = next((n for n in ("span_abs", "span") if n in df.columns), None)
    if name is None:
        return F.lit(None).cast("array<int>")
    s, e = read_right_way(name)
    return F.when(s.isNotNull(), F.array(s.cast("int"), e.cast("int")))


def nodes(contracts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One Corpus node per contract, one Chunk node per chunk, with the columns of NODE.

    leaf says that no chunk has it as parent. A chunk without a file_path has that of its contract. A corpus' content is
    its body, where there is one, else its text. Columns that an input lacks are null.
    """
    parents = chunks.where("parent_id is not null").select(F.col("parent_id").alias("chunk_id"), F.lit(False).alias("leaf_")).distinct()
    corpus = contracts.select(
        F.col("doc_id").alias("id"), F.lit("Corpus").alias("label"), basename("file_path").alias("name"), "file_path", _column(contracts, "string", "toc_json").alias("toc_json"),
        _column(contracts, "string", "body", "content").alias("content"), _column(contracts, "string", "summary").alias("summary"), F.lit(None).cast("array<int>").alias("span"),
        F.lit(None).cast("int").alias("ord"), F.lit(0).alias("depth"), F.lit(False).alias("leaf"), _column(contracts, "array<float>", "vector").alias("vector"),
    )
    rows = chunks.withColumn("path_", _column(chunks, "string", "file_path"))
    if "doc_id" in chunks.columns:  # only rows without a path meet the contracts
        paths = contracts.select("doc_id", F.col("file_path").alias("contract_path"))
        lost = rows.where("path_ is null").join(paths, "doc_id", "left").withColumn("path_", F.col("contract_path")).select(*rows.columns)
        rows = rows.where("path_ is not null").unionByName(lost)
    chunk = rows.join(parents, "chunk_id", "left").select(
        F.col("chunk_id").alias("id"), F.lit("Chunk").alias("label"), "name", F.col("path_").alias("file_path"), F.lit(None).cast("string").alias("toc_json"),
        _column(rows, "string", "content").alias("content"), _column(rows, "string", "summary").alias("summary"), _span(rows).alias("span"),
        "ord", "depth", F.coalesce("leaf_", F.lit(True)).alias("leaf"), _column(rows, "array<float>", "vector").alias("vector"),
    )
    return corpus.unionByName(chunk)


def with_vectors(nodes: DataFrame, embedder: Embedder, batch: int = 4) -> DataFrame:
    """nodes with the vector of each that has a text: its trimmed summary if that is not blank, else its content."""
    summary = trimmed("summary")
    text = F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(F.col("content"))
    asked = embed(nodes.drop("vector").withColumn("__said", text), "__said", embedder, "vector", batch)
    return asked.withColumn("vector", F.col("vector").cast("array<float>")).select(*nodes.columns)


def child_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): from the parent, or from the contract for chunks of the top level."""
    return chunks.select(F.coalesce("parent_id", "doc_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("CHILD").alias("type")).where("src is not null")


def sibling_edges(chunks: DataFrame) -> DataFrame:
    """NEXT and PREV between consecutive siblings, both always written."""
    rows = chunks.select("chunk_id", "ord", F.coalesce("parent_id", "doc_id").alias("above")).where("above is not null")
    pairs = rows.withColumn("before", F.lag("chunk_id").over(ordered("above"))).where("before is not null")
    both = F.explode(F.array(F.struct(F.col("before").alias("src"), F.col("chunk_id").alias("dst"), F.lit("NEXT").alias("type")), F.struct(F.col("chunk_id").alias("src"), F.col("before").alias("dst"), F.lit("PREV").alias("type"))))
    return pairs.select(both.alias("e")).select("e.*")


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """(label, id, n) of ids that are not unique within their label: must be empty."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")


def neighbours(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, section_id, section_name, summary): the chunks after and before each chunk; an empty summary gives way to the content."""
    next_ = edges.where("type = 'NEXT'")
    pairs = next_.select(F.col("src").alias("chunk_id"), F.col("dst").alias("section_id")).union(next_.select("dst", "src")).distinct()
    told = chunks.select(F.col("chunk_id").alias("section_id"), F.col("name").alias("section_name"), F.coalesce(F.nullif("summary", F.lit("")), "content").alias("summary"))
    return pairs.join(told, "section_id").select("chunk_id", "section_id", "section_name", "summary")


def embed_text(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): the trimmed summary if it is not blank, else the content; chunks for which it is blank are skipped."""
    summary = trimmed("summary")
    text = F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(F.col("content"))
    return chunks.select("chunk_id", text.alias("text")).where(F.coalesce(trimmed("text"), F.lit("")) != "")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, clear: bool = True) -> None:
    """Write both tables under path. clear replaces what is there, else rows are added; ids repeated within a label are refused."""
    mode = "overwrite" if clear else "append"
    if not repeated_ids(nodes).isEmpty():
        raise ValueError("node ids are not unique within their label")
    nodes.write.mode(mode).partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("type").parquet(f"{path}/edges")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new added, those with the same (label, id) replaced."""
    return old.join(new.select("label", "id"), ["label", "id"], "left_anti").unionByName(new)


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
