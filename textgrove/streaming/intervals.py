"""Continuous form of the interval operator: an ordered disjoint-interval map per key in the state store.

Gaps within a block are found by the block's own map. A gap across blocks lies between the end of one block's last
stretch and the start of the next block's first, which are the greatest end and the least start that the block has seen.
These two travel to one more group per key, reduced to a row per key and block within each Arrow batch, so that one
stateful step finds both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import BLOCK, IntervalMap

_STATE = "starts array<bigint>, ends array<bigint>"
_OUT = "key string, block bigint, gap_start bigint, gap_end bigint, open boolean"


def _with_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, s, e) -> the same with edge false, and per key and block a row of the least s and greatest e with edge true, block 0."""
    names = ["key", "block", "s", "e", "edge"]
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([False] * batch.num_rows, pa.bool_())], names=names)
        t = pa.Table.from_batches([batch]).group_by(["key", "block"]).aggregate([("s", "min"), ("e", "max")]).combine_chunks()
        n = t.num_rows
        edges = pa.table([t["key"], pa.array([0] * n, pa.int64()), t["s_min"], t["e_max"], pa.array([True] * n, pa.bool_())], names=names)
        yield from edges.to_batches()


def _update(block: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def edge_gaps(held: dict[int, tuple[int, int]]) -> set[tuple[int, int]]:
        spans = [held[b] for b in sorted(held)]
        return {(a[1], b[0]) for a, b in zip(spans[:-1], spans[1:], strict=True) if a[1] < b[0]}

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, _, edge = key
        starts, ends = state.get if state.exists else ([], [])
        rows = ((int(s), int(e)) for frame in frames for s, e in zip(frame["s"].tolist(), frame["e"].tolist(), strict=True))
        if edge:  # of each block the least start and the greatest end
            spans = {s // block: (s, e) for s, e in zip(starts, ends, strict=True)}
            before = edge_gaps(spans)
            for s, e in rows:
                s0, e0 = spans.get(s // block, (s, e))
                spans[s // block] = min(s, s0), max(e, e0)
            state.update(([spans[b][0] for b in sorted(spans)], [spans[b][1] for b in sorted(spans)]))
            after = edge_gaps(spans)
        else:
            held = IntervalMap(list(starts), list(ends))
            before = set(held.gaps())
            for s, e in rows:
                held.insert(s, e)
            state.update((held.starts, held.ends))
            after = set(held.gaps())
        out = [(name, (g[0] - 1) // block, *g, False) for g in sorted(before - after)] + [(name, (g[0] - 1) // block, *g, True) for g in sorted(after - before)]
        if out:
            yield pd.DataFrame(out, columns=["key", "block", "gap_start", "gap_end", "open"])

    return update


def gap_changes(stream: DataFrame, key: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """(key, block, gap_start, gap_end, open): a row when a gap appears between two stretches of a key, and one with open false when it closes or changes.

    block is that in which the stretch before the gap ends. State is held per key and block of the axis, so a key of any
    weight is spread over its blocks; intervals that cross blocks are cut there. One more state per key holds two numbers
    for each of its blocks, for the gaps across blocks. Null keys or ends and empty or backwards intervals are left out.
    Replaying a batch gives the same state, as intervals may be inserted repeatedly.
    """
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    rows = stream.select(F.col(key).cast("string").alias("key"), s.alias("s0"), e.alias("e0")).where("key is not null and s0 < e0")
    blocks = F.sequence(F.floor(F.col("s0") / F.lit(block)).cast("bigint"), F.floor((F.col("e0") - 1) / F.lit(block)).cast("bigint"))
    rows = rows.withColumn("block", F.explode(blocks)).select("key", "block", F.greatest("s0", F.col("block") * block).alias("s"), F.least("e0", (F.col("block") + 1) * block).alias("e"))
    rows = rows.mapInArrow(_with_edges, "key string, block bigint, s bigint, e bigint, edge boolean")
    return rows.groupBy("key", "block", "edge").applyInPandasWithState(_update(block), _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
