"""Overlapping and gapped intervals: continuous periods per entity, and the gaps between them.

Each entity's axis is divided into blocks. A task holds, for one (entity, block) at a time, an ordered map of disjoint
intervals; an insertion finds the stretches it meets by binary search, merges them and thereby closes gaps. Periods
that lie within a block are final. Only the first and last stretch of every block pass through a window per entity, so
an entity that owns a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 20


class IntervalMap:
    """Disjoint half-open intervals in order; touching ones are one."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> None:
        """Add [start, end); an empty or backwards interval adds nothing."""
        if start >= end:
            return
        lo = bisect_left(self.ends, start)  # the first stretch that ends at or after start
        hi = bisect_right(self.starts, end)  # after the last stretch that starts at or before end
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (__key, __block, __s, __e) sorted by key and block -> disjoint stretches (…, __edge: first or last of the block)."""
    state, at = IntervalMap(), None
    out: list[tuple] = []

    def close() -> None:
        n = len(state.starts)
        out.extend((*at, s, e, i in (0, n - 1), state.ends[i - 1] if i else None) for i, (s, e) in enumerate(zip(state.starts, state.ends, strict=True)))

    def flush() -> pa.RecordBatch:
        k, b, s, e, edge, before = zip(*out, strict=True) if out else ((),) * 6
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.string()), pa.array(b, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(edge, pa.bool_()), pa.array(before, pa.int64())],
            names=["__key", "__block", "__s", "__e", "__edge", "__before"],
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != at:
                if at is not None:
                    close()
                state, at = IntervalMap(), row[:2]
            state.insert(row[2], row[3])
        if len(out) > 50_000:
            yield flush()
    if at is not None:
        close()
    yield flush()


def _block_for(rows: DataFrame, block: int) -> int:
    """The block, or the least of its multiples by powers of 8 with which the intervals' parts come to at most 8 a row and a million in all: intervals may be of any length."""
    sizes = [block * 8**i for i in range(20) if block * 8**i < 1 << 62]
    parts = lambda b: F.sum((F.floor((F.col("__e0") - 1) / F.lit(b)) - F.floor(F.col("__s0") / F.lit(b)) + 1).cast("double"))
    counted = rows.agg(F.count("*").alias("n"), *[parts(b).alias(f"b{i}") for i, b in enumerate(sizes)]).first()
    return next((b for i, b in enumerate(sizes) if (counted[f"b{i}"] or 0) <= 8 * counted["n"] + 1_000_000), sizes[-1])


def stretches(df: DataFrame, key: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """Disjoint stretches per key and block; see the module's text. Rows with a null key, start or end, and empty intervals, are left out."""
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    rows = df.select(F.col(key).cast("string").alias("__key"), s.alias("__s0"), e.alias("__e0")).where("__key is not null and __s0 < __e0")
    block = _block_for(rows, block)
    first, last = F.floor(F.col("__s0") / F.lit(block)).cast("bigint"), F.floor((F.col("__e0") - 1) / F.lit(block)).cast("bigint")
    rows = rows.withColumn("__block", F.explode(F.sequence(first, last)))
    rows = rows.groupBy("__key", "__block", F.greatest("__s0", F.col("__block") * block).alias("__s")).agg(F.max(F.least("__e0", (F.col("__block") + 1) * block)).alias("__e"))
    rows = rows.repartition("__key", "__block").sortWithinPartitions("__key", "__block", "__s")
    return rows.select("__key", "__block", "__s", "__e").mapInArrow(_blocks, "__key string, __block bigint, __s bigint, __e bigint, __edge boolean, __before bigint")


def covered_gaps(df: DataFrame, key: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """(key, gap_start, gap_end): each gap between two successive continuous stretches of a key.

    Touching intervals are continuous. Nothing is listed before the first or after the last stretch. Null keys or ends
    and empty or backwards intervals do not count; repeated rows change nothing; no rows give no rows.
    """
    cells = stretches(df, key, start, end, block)
    by_key = Window.partitionBy("__key").orderBy("__s")
    edges = cells.where("__edge").withColumn("__prev", F.lag("__e").over(by_key)).withColumn("__pb", F.lag("__block").over(by_key))
    across = edges.where("__pb <> __block and __s > __prev").select("__key", F.col("__prev").alias("gap_start"), F.col("__s").alias("gap_end"))
    inside = cells.where("__before is not null").select("__key", F.col("__before").alias("gap_start"), F.col("__s").alias("gap_end"))
    return inside.unionByName(across).withColumnRenamed("__key", key)


def covered_periods(df: DataFrame, key: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """(key, period_start, period_end): maximal continuous stretches per key. The cases are those of covered_gaps."""
    cells = stretches(df, key, start, end, block)
    by_key = Window.partitionBy("__key").orderBy("__s")
    edges = cells.where("__edge").withColumn("__new", (F.coalesce(F.lag("__e").over(by_key), F.col("__s") - 1) < F.col("__s")).cast("bigint"))
    edges = edges.withColumn("__run", F.sum("__new").over(by_key))
    joined = edges.groupBy("__key", "__run").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e")).select("__key", "__s", "__e")
    return cells.where("not __edge").select("__key", "__s", "__e").unionByName(joined).toDF(key, "period_start", "period_end")
