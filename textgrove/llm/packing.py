"""Filling containers of fixed capacity with items, never splitting one that fits.

Items are dealt into partitions; each packs its own by best-fit decreasing and certifies its bin count against a lower
bound from dual-feasible functions. Partitions whose count exceeds the bound put the items of their unfilled bins into
new partitions, together with those of other such partitions, and pack again; a round that saves no bin ends the work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop

CAPACITY = 8_192


def byte_tokens(text: str | Column) -> Column:
    """Tokens of a byte-level tokenizer: one per UTF-8 byte and an end token."""
    return F.octet_length(text).cast("bigint") + 1


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The greatest of three dual-feasible bounds on the bins that the sizes need: their sum; the threshold functions that
    drop items below t and round items above capacity - t up to a bin, for every t; the rounding functions u(k), k to 32."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    mass = count * np.arange(capacity + 1)
    n, m = np.cumsum(count), np.cumsum(mass)
    t = np.arange(0, capacity // 2 + 1)
    full = n[-1] - n[capacity - t]
    below = np.where(t > 0, m[np.maximum(t - 1, 0)], 0)
    best = int((full + -(-(m[capacity - t] - below) // capacity)).max())
    x = np.flatnonzero(count)
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        # in units of 1 / (k * capacity): an item that is a multiple of capacity / (k + 1) keeps its size, others round down
        weight = np.where(whole, k * x, capacity * ((k + 1) * x // capacity))
        best = max(best, math.ceil(int((weight * count[x]).sum()) / (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: largest first, each into the fullest bin that takes it."""
    bins = np.empty(len(sizes), np.int64)
    stacks: dict[int, list[int]] = {}
    open_rooms, n = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = open_rooms >> s
        if fits:
            room = (fits & -fits).bit_length() - 1 + s
            b = stacks[room].pop()
            if not stacks[room]:
                open_rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        room -= s
        if room:
            stacks.setdefault(room, []).append(b)
            open_rooms |= 1 << room
    return bins


def pack(items: DataFrame, id_col: str, size: str, capacity: int = CAPACITY, per_part: int = 20_000, rounds: int = 4) -> DataFrame:
    """(id, piece, pieces, size, container): every item placed, container a number.

    An item larger than capacity is cut into full pieces, each a container of its own, and a last piece that is packed
    like an item. Items with a null or negative size are left out; size 0 counts as 0 and takes no room. Repeated rows
    are separate items. No rows give no rows.
    """
    rows = items.select(F.col(id_col).alias("id"), F.col(size).cast("bigint").alias("whole")).where("whole >= 0")
    rows = rows.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("whole") / capacity)).cast("bigint"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    rows = rows.withColumn("size", F.when(F.col("piece") < F.col("pieces") - 1, F.lit(capacity)).otherwise(F.col("whole") - capacity * (F.col("pieces") - 1)).cast("bigint")).drop("whole")
    rows = cut(rows, "pieces")
    full = rows.where(F.col("size") == capacity).select("id", "piece", "pieces", "size", F.lit(-1).alias("round"), F.xxhash64("id", "piece").alias("part"), F.lit(0).cast("bigint").alias("bin"))
    todo = rows.where(F.col("size") < capacity)
    n = todo.count()
    if not n:
        return full.select("id", "piece", "pieces", "size", F.concat_ws("-", "round", "part", "bin").alias("container"))
    parts = -(-n // per_part)
    schema = "id bigint, piece bigint, pieces bigint, size bigint, part bigint, bin bigint, left bigint, gap bigint"
    fields = {f.name: f.dataType for f in rows.schema}
    if fields["id"].simpleString() != "bigint":
        schema = schema.replace("id bigint", f"id {fields['id'].simpleString()}", 1)

    def one(t: pa.Table) -> pa.Table:
        sizes = t["size"].to_numpy()
        order = np.lexsort((t["piece"].to_numpy(), t["h"].to_numpy(), -sizes))  # the same rows give the same bins in any order
        t, sizes = t.take(pa.array(order)), sizes[order]
        bins = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        gap = len(used) - lower_bound(sizes, capacity)
        cols = {c: t[c] for c in ("id", "piece", "pieces", "size", "part")}
        return pa.table(cols | {"bin": pa.array(bins), "left": pa.array(capacity - used[bins]), "gap": pa.array(np.full(len(bins), gap, np.int64))})

    def packed(df: DataFrame, seed: int, parts: int) -> DataFrame:
        h = F.xxhash64("id", "piece", F.lit(seed))
        return cut(df.select("id", "piece", "pieces", "size", F.pmod(h, F.lit(parts)).cast("bigint").alias("part"), h.alias("h")).groupBy("part").applyInArrow(one, schema), "packed")

    done, now = [full], packed(todo, 0, parts)
    for r in range(1, rounds + 1):
        # certified partitions and full bins are final
        bins = now.where("gap > 0 and left > 0").select("part", "bin", "size", "gap")
        summary = bins.agg(F.sum("size").alias("mass"), F.countDistinct("part", "bin").alias("bins"), F.count("*").alias("n")).first()
        if not summary["bins"] or summary["bins"] <= -(-summary["mass"] // capacity):
            break
        again = packed(now.where("gap > 0 and left > 0").select("id", "piece", "pieces", "size"), r, max(1, -(-summary["n"] // per_part)))
        if again.select("part", "bin").distinct().count() >= summary["bins"]:
            drop(again)
            break
        done.append(now.where("gap <= 0 or left = 0").select("id", "piece", "pieces", "size", F.lit(r - 1).alias("round"), "part", "bin"))
        now = again
    done.append(now.select("id", "piece", "pieces", "size", F.lit(len(done) - 1).alias("round"), "part", "bin"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "piece", "pieces", "size", F.concat_ws("-", "round", "part", "bin").alias("container"))
