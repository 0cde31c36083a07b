"""Building the graph from raw texts: split, table of contents, tree of located chunks, summaries bottom-up, vectors."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Embedder, TextModel, apply_model, boundaries_by_headings, first_sentences, letter_counts, toc_by_headings
from ..functions.text import MARKER, first_of, model_json, split_at_marker, trimmed
from ..functions.windows import flat_tree
from ..operators import graph
from ..operators.tree import roll_up
from ..session import cut
from ..sources.corpus import cached, fingerprint


@dataclass(frozen=True)
class BuildConfig:
    """Models and settings of a build; the defaults are deterministic and need no network.

    The concurrencies bound the tasks that call a model at once, where a service asks for it. cache: a folder in which the
    tables of contents and the trees are kept, under a fingerprint of the texts that they come from.
    """

    marker: str = MARKER
    toc_model: TextModel = toc_by_headings
    boundary_model: TextModel = boundaries_by_headings
    summary_model: TextModel = first_sentences
    embedder: Embedder = letter_counts
    toc_concurrency: int | None = None
    chunk_concurrency: int | None = None
    summary_concurrency: int | None = None
    embed_batch: int = 64
    cache: str | None = None


TREE = "doc_id string, pre int, depth int, ord int, path array<string>, name string, is_leaf boolean, s int, e int, content string"


def _trees(batches):
    names = [f.split()[0] for f in TREE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = []
        for doc, body, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for pre, (path, order, depth, leaf, s, e) in enumerate(flat_tree(said, body)):
                rows.append((doc, pre, depth + 1, order, path, path[-1], leaf, s, e, (body or "")[s:e] if leaf else None))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def node_id(doc: Column | str, path: Column | str) -> Column:
    """The id of a node: a hash of its document and path, the same in every run."""
    return F.sha2(F.concat_ws("\x1f", doc, F.array_join(path, "\x1f")), 256)


def split_documents(raw: DataFrame, config: BuildConfig) -> DataFrame:
    """raw (doc_id, file_path, content) with intro, body, body_start, body_end and toc_json; the raw text stays."""
    parts = raw.select("doc_id", "file_path", "content", *[c.alias(n) for n, c in split_at_marker("content", config.marker).items()])
    asked = apply_model(parts.withColumn("__intro", F.when(F.col("intro") != "", trimmed("intro")).otherwise(trimmed("body"))), "__intro", config.toc_model, "__toc", "string", concurrency=config.toc_concurrency)
    return asked.withColumn("toc_json", model_json("__toc")).drop("__intro", "__toc")


def walked(documents: DataFrame, config: BuildConfig) -> DataFrame:
    """The located tree of each document as flat rows, in pre-order of pre; path holds the names from the top."""
    said = apply_model(documents.select("doc_id", "body"), "body", config.boundary_model, "__said", "string", concurrency=config.chunk_concurrency)
    return said.select("doc_id", "body", model_json("__said").alias("said")).mapInArrow(_trees, TREE)


def chunk_documents(documents: DataFrame, config: BuildConfig, flat: DataFrame | None = None) -> DataFrame:
    """One row per chunk: span_rel in the body, span_abs in the file; inner contents are those of the leaves below, in order.

    Every leaf goes to each node above it, and one aggregation joins them: the plan does not grow with the depth.
    """
    flat = flat if flat is not None else cut(walked(documents, config), "trees")
    rows = flat.withColumn("chunk_id", node_id("doc_id", "path")).withColumn("parent_id", F.when(F.col("depth") > 1, node_id("doc_id", F.slice("path", 1, F.size("path") - 1))))
    above = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda n: F.sha2(F.concat_ws("\x1f", F.col("doc_id"), F.array_join(F.slice("path", 1, n), "\x1f")), 256))
    below = rows.where("is_leaf and depth > 1").select(F.explode(above).alias("chunk_id"), F.struct("pre", "content").alias("z")).groupBy("chunk_id").agg(F.sort_array(F.collect_list("z")).alias("l"))
    below = below.select("chunk_id", F.array_join(F.transform("l", lambda z: z["content"]), "").alias("joined"))
    starts = documents.select("doc_id", "file_path", "body_start")
    rows = rows.join(below, "chunk_id", "left").withColumn("content", F.when(F.col("is_leaf"), F.col("content")).otherwise(F.coalesce("joined", F.lit("")))).join(starts, "doc_id")
    rel = F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("span_rel")
    abs_ = F.struct((F.col("s") + F.col("body_start")).alias("start"), (F.col("e") + F.col("body_start")).alias("end")).alias("span_abs")
    return rows.select("chunk_id", "doc_id", "file_path", "parent_id", "depth", "ord", "path", "name", "is_leaf", "content", rel, abs_)


def summarise(chunks: DataFrame, documents: DataFrame, config: BuildConfig) -> tuple[DataFrame, DataFrame]:
    """(chunks with summary, documents with summary): leaves from their content, then each level from its children's summaries, then documents.

    A level is written before the next one reads it; there are as many rounds as levels.
    """
    deepest = chunks.agg(F.max("depth")).first()[0] or 0
    model = lambda df: apply_model(df, "__text", config.summary_model, "summary", "string", concurrency=config.summary_concurrency).drop("__text")
    keys = ["chunk_id", "parent_id", "doc_id", "depth", "ord", "content"]
    done = level = None
    for d in range(deepest, 0, -1):  # a node's children are all one level below it
        here = chunks.where((F.col("depth") == d)).select(*keys, "is_leaf")
        if done is not None:
            told = roll_up(level, trimmed(first_of("summary", "content")), "\n\n").withColumnRenamed("parent_id", "chunk_id").withColumnRenamed("text", "told")
            here = here.join(told, "chunk_id", "left")
        else:
            here = here.withColumn("told", F.lit(None).cast("string"))
        level = cut(model(here.withColumn("__text", F.when(F.col("is_leaf"), F.col("content")).otherwise(F.coalesce("told", F.lit("")))).drop("told", "is_leaf")), "summaries")
        done = level if done is None else done.unionByName(level)
    if done is None:
        return chunks.withColumn("summary", F.lit(None).cast("string")), documents.withColumn("summary", F.lit("").cast("string"))
    tops = roll_up(done.where("depth = 1").withColumn("parent_id", F.col("doc_id")), trimmed(first_of("summary", "content")), "\n\n").select(F.col("parent_id").alias("doc_id"), F.col("text").alias("__text"))
    whole = model(documents.join(tops, "doc_id", "left").withColumn("__text", F.coalesce("__text", F.lit(""))))
    return chunks.join(done.select("chunk_id", "summary"), "chunk_id"), whole


def build(raw: DataFrame, config: BuildConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, nodes, edges) of raw texts (doc_id, file_path, content). Ids are hashes of document and path, so a rerun gives the same."""
    config = config or BuildConfig()
    if config.cache:
        mark = fingerprint(raw, "doc_id", "file_path", "content")
        documents = cached(raw.sparkSession, f"{config.cache}/toc-{mark}", lambda: split_documents(raw, config))
        flat = cached(raw.sparkSession, f"{config.cache}/trees-{mark}", lambda: walked(documents, config))
        chunks = cut(chunk_documents(documents, config, flat), "chunks")
    else:
        documents = cut(split_documents(raw, config), "documents")
        chunks = cut(chunk_documents(documents, config), "chunks")
    chunks, documents = summarise(chunks, documents, config)
    chunks, documents = cut(chunks, "chunks"), cut(documents, "documents")
    nodes = graph.with_vectors(graph.nodes(documents, chunks), config.embedder, config.embed_batch)
    edges = graph.child_edges(chunks).unionByName(graph.sibling_edges(chunks))
    return documents, chunks, nodes, edges


__all__ = ["BuildConfig", "build", "chunk_documents", "node_id", "split_documents", "summarise", "walked"]
