"""Continuous forms of the stateless steps: split a stream of texts, and write each batch to the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKER, split_at_marker
from ..operators.graph import child_edges, nodes, sibling_edges, write_graph


def split_stream(texts: DataFrame, content: str = "content", marker: str = MARKER) -> DataFrame:
    return texts.select("*", *[c.alias(n) for n, c in split_at_marker(content, marker).items()])


def append_graph(path: str, contracts_of, chunks_of):
    """A function for foreachBatch: adds the nodes and edges of each batch of documents to the graph at path."""

    def write(batch: DataFrame, _epoch: int) -> None:
        contracts, chunks = contracts_of(batch), chunks_of(batch)
        write_graph(nodes(contracts, chunks), child_edges(chunks).unionByName(sibling_edges(chunks)), path, clear=False)

    return write


def page_windows(pages: DataFrame, minutes: int = 10) -> DataFrame:
    """Documents and characters by source in tumbling windows of their delivery, late rows up to the window's length."""
    return pages.withWatermark("ingested_at", f"{minutes} minutes").groupBy(F.window("ingested_at", f"{minutes} minutes"), "source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))
