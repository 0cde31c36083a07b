"""Trees of chunks as flat rows: one row per chunk, envelopes, roll-ups, subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_of, trimmed
from ..sources.tables import read_right_way


def latest(df: DataFrame, key: str, *columns: str, prefer: str | None = None) -> DataFrame:
    """One row per key, of those delivered repeatedly the latest by ingested_at, one with a non-null `prefer` first. Null keys are left out.

    The reduction starts before the shuffle and moves only the columns asked for.
    """
    order = F.struct(*([F.col(prefer).isNotNull()] if prefer else []), F.col("ingested_at"))
    columns = [c for c in columns if c != key]
    row = F.struct(*columns) if columns else F.struct(F.lit(1).alias("__one"))
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, order).alias("__row"))
    return picked.select(key, *[F.col("__row")[c].alias(c) for c in columns])


def ordered(parent: str = "parent_id") -> Window:
    return Window.partitionBy(parent).orderBy(F.col("ord").asc_nulls_last(), "chunk_id")


def text_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ord, line, span_start, span_end) of each LF-separated line; offsets in code points. A null text has no lines, an empty one has one."""
    lines = documents.select(doc_id, F.posexplode(F.split(text, "\n")).alias("ord", "line"))
    before = Window.partitionBy(doc_id).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("bigint")
    return lines.select(doc_id, "ord", "line", start.alias("span_start"), (start + F.length("line")).alias("span_end"))


def envelopes(chunks: DataFrame) -> DataFrame:
    """(parent_id, span_start, span_end, children): least start and greatest end of each parent's children; null spans count as children only."""
    s, e = read_right_way()
    return chunks.where("parent_id is not null").groupBy("parent_id").agg(F.min(s).alias("span_start"), F.max(e).alias("span_end"), F.count("*").alias("children"))


def roll_up(chunks: DataFrame, value, separator: str) -> DataFrame:
    """(parent_id, text): the children's values in their order (ord, then chunk_id), joined. The order is made explicit before joining."""
    item = F.struct(F.col("ord").isNull().alias("none"), "ord", "chunk_id", value.alias("x"))
    held = chunks.where("parent_id is not null").groupBy("parent_id").agg(F.sort_array(F.collect_list(item)).alias("l"))
    return held.select("parent_id", F.array_join(F.transform("l", lambda z: z["x"]), separator).alias("text"))


def content_roll_up(chunks: DataFrame) -> DataFrame:
    return roll_up(chunks, F.coalesce("content", F.lit("")), "")


def summary_roll_up(chunks: DataFrame) -> DataFrame:
    return roll_up(chunks, trimmed(first_of("summary", "content")), "\n\n")


def levels(chunks: DataFrame) -> DataFrame:
    """(doc_id, depth, chunks, leaves) of each level of each document."""
    parents = chunks.where("parent_id is not null").select(F.col("parent_id").alias("chunk_id"), F.lit(True).alias("inner")).distinct()
    return chunks.join(parents, "chunk_id", "left").groupBy("doc_id", "depth").agg(F.count("*").alias("chunks"), F.count_if(F.col("inner").isNull()).alias("leaves"))


def descendants(chunks: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(ancestor, chunk_id, distance): every chunk with each of its ancestors, distance from 1.

    One join a level; as many levels as the deepest chunk has, which is read first where not given.
    """
    links = chunks.where("parent_id is not null").select("chunk_id", "parent_id")
    deepest = most_depth if most_depth is not None else (chunks.agg(F.max("depth")).first()[0] or 0)
    step = links.select(F.col("parent_id").alias("ancestor"), "chunk_id", F.lit(1).alias("distance"))
    out = step
    up = links.select(F.col("chunk_id").alias("ancestor"), F.col("parent_id").alias("above"))
    for d in range(2, deepest + 1):
        step = step.join(up, "ancestor").select(F.col("above").alias("ancestor"), "chunk_id", F.lit(d).alias("distance"))
        out = out.unionByName(step)
    return out
