"""Splitting oversized items at natural boundaries, with an overlap between consecutive pieces.

Boundaries are the ends of gaps (maximal runs of space, tab, CR and LF), of three strengths: a gap with two or more LF, a
gap right after one of . ! ? ;, any gap. Two ways of placing the cuts share them:

balanced    the least number of pieces that the limit and the overlap allow, targets at equal distances, each snapped to
            the strongest boundary near it, and a piece more where the limit would else be exceeded;
sequential  from the front, each piece ends at the strongest boundary in the second half of its room, at the last one of
            that strength, or at the limit.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GAP = re.compile(r"[ \t\r\n]+")
STRENGTHS = 3


def boundaries(text: str) -> list[list[int]]:
    """Positions just after a gap, ascending: [after a blank line, after a sentence, after any gap]."""
    strong, middle, weak = [], [], []
    for m in _GAP.finditer(text):
        start, end = m.span()
        weak.append(end)
        if text.count("\n", start, end) > 1:
            strong.append(end)
        if start and text[start - 1] in ".!?;":
            middle.append(end)
    return [strong, middle, weak]


def sequential_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """A piece at s takes the rest if that is at most limit; else it ends at s + limit // 2 < end <= s + limit, at the last
    boundary of the strongest kind that has one there, or at s + limit. The next piece starts overlap before that end."""
    n, s, out = len(text), 0, []
    kinds = boundaries(text) if n > limit else []
    while n - s > limit:
        end = s + limit
        for kind in kinds:
            i = bisect_right(kind, s + limit) - 1
            if i >= 0 and kind[i] > s + limit // 2:
                end = kind[i]
                break
        out.append((s, end))
        s = end - overlap
    out.append((s, n))
    return out


def balanced_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of nearly equal length: see the module's text.

    The targets are those of the text that is left, so a cut that falls early shifts the ones after it, and a piece is
    added only where those would exceed the limit. A cut may fall later than its target by the slack that the limit
    leaves, and earlier by as much or by a quarter of the limit. The work is linear in the text.
    """
    n, s, out = len(text), 0, []
    kinds = boundaries(text) if n > limit else []
    while n - s > limit:
        count = math.ceil((n - s - overlap) / (limit - overlap))
        length = (n - s + (count - 1) * overlap) / count
        room = max(0, int(limit - length))
        target = s + round(length)
        low, high = max(s + overlap + 1, target - max(room, limit // 4)), min(s + limit, target + room)
        end = target
        for kind in kinds:
            a, b = bisect_left(kind, low), bisect_right(kind, high)
            if a < b:
                i = bisect_left(kind, target, a, b)
                end = min(kind[max(a, i - 1) : min(b, i + 1)], key=lambda p: (abs(p - target), p))
                break
        out.append((s, end))
        s = end - overlap
    return [*out, (s, n)]


def split_oversized(items: DataFrame, id_col: str = "item_id", text: str = "text", offset: str = "offset", limit: int = 1_200, overlap: int = 120, method: str = "balanced") -> DataFrame:
    """(item_id, piece_start, piece_end) of every item longer than limit, in code points, offset added.

    Items of at most limit, and null or empty texts, give no rows; a null id or offset gives a null id, or counts as 0.
    Repeated items give repeated pieces: reduce them first. The length test runs before Python sees a text. Overlap must
    be less than half the limit.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be from 0 to less than half the limit")
    place = {"balanced": balanced_pieces, "sequential": sequential_pieces}[method]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, t, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s, e in place(t, limit, overlap):
                    ids.append(i)
                    starts.append(s + o)
                    ends.append(e + o)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["item_id", "piece_start", "piece_end"])

    long = items.select(F.col(id_col).cast("string").alias("i"), F.col(text).alias("t"), F.coalesce(F.col(offset).cast("bigint"), F.lit(0).cast("bigint")).alias("o")).where(F.length("t") > limit)
    return long.mapInArrow(cut, "item_id string, piece_start bigint, piece_end bigint")
