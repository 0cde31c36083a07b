"""Tools of the search loop as set operators, and a deterministic policy that drives them for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.models import Embedder, embed, letter_counts
from ..functions.text import basename
from ..functions.windows import letters, toc_udf
from .vectors import child_topk


def list_corpora(contracts: DataFrame) -> DataFrame:
    """(contract_id, contract_name) in order of name, nulls last, then id."""
    return contracts.select(F.col("doc_id").alias("contract_id"), basename("file_path").alias("contract_name")).orderBy(F.asc_nulls_last("contract_name"), "contract_id")


def corpus_toc(contracts: DataFrame) -> DataFrame:
    """(contract_id, ord, component_name, component_description, childs): the normalised table of contents, one row a component."""
    rows = contracts.select(F.col("doc_id").alias("contract_id"), F.posexplode(toc_udf("toc_json")).alias("ord", "c"))
    return rows.select("contract_id", "ord", "c.component_name", "c.component_description", "c.childs")


def locate_spans(chunks: DataFrame, contracts: DataFrame) -> DataFrame:
    """(chunk_id, file_path, name, span_start, span_end): the first occurrence of each chunk's content in its contract, as offsets in the file.

    A chunk whose content is null or is not found is dropped; empty content is found at the start. The stored span plays no part.
    """
    texts = contracts.select("doc_id", F.col("file_path").alias("path"), F.col("content").alias("hay"), F.coalesce("file_offset", F.lit(0)).alias("at"))
    hit = chunks.where("content is not null").select("chunk_id", "doc_id", "name", "content").join(texts, "doc_id").withColumn("p", F.call_function("instr", F.col("hay"), F.col("content"))).where("p > 0")
    start = F.col("p") - 1 + F.col("at")
    return hit.select("chunk_id", F.col("path").alias("file_path"), "name", start.cast("bigint").alias("span_start"), (start + F.length("content")).cast("bigint").alias("span_end"))


def search_children(queries: DataFrame, nodes: DataFrame, edges: DataFrame, embedder: Embedder = letter_counts, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """(query_id, pos, component_id, component_name, component_summary, component_leaf) for queries (query_id, id, query).

    The k children of node id whose vectors are most similar to the query's vector, best first, above the threshold; an
    empty summary gives way to the content. Ids that are no node, null queries and children without a vector give no rows.
    """
    asked = embed(queries.select("query_id", F.col("id").alias("parent"), "query"), "query", embedder, "q").select("query_id", "parent", "q")
    chunks = nodes.where("label = 'Chunk'")
    children = edges.where("type = 'CHILD'").select(F.col("src").alias("parent"), F.col("dst").alias("id")).join(chunks.select("id", F.col("vector").alias("v")), "id")
    best = child_topk(children, asked, k, threshold).select("query_id", "id", F.col("rank").alias("pos"))
    told = F.coalesce(F.nullif("summary", F.lit("")), "content")
    return best.join(chunks.select("id", "name", told.alias("told"), "leaf"), "id").select("query_id", "pos", F.col("id").alias("component_id"), F.col("name").alias("component_name"), F.col("told").alias("component_summary"), F.col("leaf").alias("component_leaf"))


def response_by_ids(asked: DataFrame, chunks: DataFrame, contracts: DataFrame) -> DataFrame:
    """(query_id, place, chunk_id, file_path, name, content, span_start, span_end) for asked (query_id, ids array).

    Ids asked twice count once, unknown ones and those whose content is not found vanish; place is the order of the
    first mention. chunks without doc_id are sought in every volume of their file; of several finds the first counts.
    """
    ids = asked.select("query_id", F.posexplode(F.array_distinct("ids")).alias("at", "chunk_id")).where("chunk_id is not null")
    wanted = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    placed = wanted if "doc_id" in chunks.columns else wanted.join(contracts.select("doc_id", "file_path"), "file_path").select("chunk_id", "doc_id", "name", "content")
    found = locate_spans(placed, contracts).groupBy("chunk_id").agg(F.min(F.struct("span_start", "span_end", "file_path")).alias("r"))
    told = wanted.groupBy("chunk_id").agg(F.min(F.struct("name", "content")).alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return ids.join(found, "chunk_id").join(told, "chunk_id").withColumn("place", place).select("query_id", "place", "chunk_id", "r.file_path", "n.name", "n.content", "r.span_start", "r.span_end")


def answers(snippets: DataFrame, contracts: DataFrame) -> DataFrame:
    """(test_id, pos, doc_id, answer): the text of each snippet, from the volume of the file that holds it wholly."""
    texts = contracts.select("doc_id", "file_path", "content", F.coalesce("file_offset", F.lit(0)).alias("at"), F.length("content").alias("n"))
    inside = (F.col("span.start") >= F.col("at")) & (F.col("span.end") <= F.col("at") + F.col("n")) & (F.col("span.start") <= F.col("span.end"))
    rows = snippets.distinct().join(texts, "file_path").where(inside)
    return rows.select("test_id", "pos", "doc_id", F.substring("content", F.col("span.start") - F.col("at") + 1, F.col("span.end") - F.col("span.start")).alias("answer"))


def answer_questions(questions: DataFrame, contracts: DataFrame, chunks: DataFrame, leaves: int = 2, embedder: Embedder | None = None) -> DataFrame:
    """(test_id, place, chunk_id, file_path, span_start, span_end, score) for questions (test_id, query).

    All questions advance together, a round per join: the contracts whose name the question holds; their best top
    component by cosine of the embedder's vectors (letter counts, as built-in functions, unless given); its best `leaves` children; their spans in the source; scores 1 / place.
    Questions without a matching contract, component or found span have no row.
    """
    stem = F.regexp_replace(F.regexp_replace(basename("file_path"), r"\.txt$", ""), "_", " ")
    named = contracts.select(F.col("doc_id").alias("parent"), stem.alias("phrase")).where("phrase is not null and phrase <> ''")
    asked = questions.where("query is not null").select("test_id", F.regexp_extract("query", "^Consider (.*?);", 1).alias("phrase"), "query")
    rows = chunks.select(F.coalesce("parent_id", "doc_id").alias("parent"), F.col("chunk_id").alias("id"), F.coalesce(F.nullif("summary", F.lit("")), "content", F.lit("")).alias("t"))
    vector = lambda df, text, out: df.withColumn(out, letters(text)).drop(text) if embedder is None else embed(df, text, embedder, out).drop(text)
    asked, rows = vector(asked, "query", "q"), vector(rows, "t", "v")
    first = child_topk(rows, asked.join(named, "phrase").select(F.col("test_id").alias("query_id"), "parent", "q"), 1)
    by_test = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    first = first.withColumn("r", F.row_number().over(by_test)).where("r = 1").select("query_id", F.col("id").alias("parent"))
    second = child_topk(rows, first.join(asked.withColumnRenamed("test_id", "query_id"), "query_id").select("query_id", "parent", "q"), leaves)
    hits = second.select("query_id", F.col("id").alias("chunk_id"), "rank").join(locate_spans(chunks, contracts), "chunk_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("place", place).select(F.col("query_id").alias("test_id"), "place", "chunk_id", "file_path", "span_start", "span_end", (F.lit(1.0) / F.col("place")).alias("score"))


def round_log(messages: DataFrame, key: str, at: str, order: str, tool: str, budget: int) -> DataFrame:
    """Messages with `round`, the count of tool messages up to each, cut where it would pass the budget."""
    by = Window.partitionBy(key).orderBy(at, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("round", F.sum(F.expr(tool).cast("bigint")).over(by)).where(F.col("round") <= budget)


def carried(messages: DataFrame, key: str, at: str, order: str, value) -> DataFrame:
    """Messages with `last_entry`, the latest non-null value before each within its key; it starts anew with every key."""
    by = Window.partitionBy(key).orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("last_entry", F.last(value, ignorenulls=True).over(by))
