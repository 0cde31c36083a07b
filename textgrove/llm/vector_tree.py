"""Nearest neighbours of every vector through a hierarchical k-means tree.

The first two levels of the tree, cells and leaves, are fitted on the driver from a bounded sample. Every vector visits
leaves in best-bin-first order: a priority queue holds nodes by their similarity to the vector; taking a cell pushes its
leaves, taking a leaf counts as a visit. Visited leaves of one cell travel together: a vector is shuffled once per visited
cell, and there it is compared with every vector that visits the cell, so a pair is met if their visits share a cell. How
many visits a vector makes is calibrated: they are widened until the recall of sampled queries, held against a scan of all
vectors, reaches the target.

A cell that outgrows a bound, as all do when the table grows and the sample does not, gets a tree of its own: fitted in an
executor from a bounded sample of its vectors, which then visit its leaves in turn, level by level until the cells are
small. So leaves keep their size however many vectors there are, and the driver holds the first levels only. Cells that
no further tree divides, and those somewhat too large, are worked on in a grid of blocks: a task holds two groups of their
vectors at most. Exact copies of a vector are reduced to one before the shuffle, within each map task, and again in the
cell's task.

A vector is shuffled once per visited cell and group of the cell's grid, which grows with the table. So the work is done
in turns, each of which shuffles about as many rows as the table has, and the files of a turn are deleted before the next.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, drop, release


@dataclass(frozen=True)
class TreeConfig:
    """sample: most vectors the first levels are fitted on. leaf: members aimed at per leaf. leaves: most leaves of one fit.
    target: recall to be reached by the calibration. probes: sampled queries of the calibration, none of them fitted where the sample is not all rows.
    block: most vectors of one group in the grid of a cell. refine: vectors beyond which a cell gets a tree of its own. part: vectors such a tree is fitted on.
    spare: by what factor the visits exceed those that reach the target on the sampled queries. gain: the quantile that stands for the usual gain of a cell's leaves on its centre.
    per_cell: leaves per cell. seed: of the samples and the fits. turn: rows that a turn of the work may shuffle, if the table has not more."""

    sample: int = 16_384
    leaf: int = 150
    leaves: int = 2_048
    target: float = 0.995
    probes: int = 1_024
    block: int = 12_000
    refine: int = 150_000
    part: int = 8_192
    gain: float = 0.9
    per_cell: int = 20
    spare: float = 1.0
    seed: int = 7
    turn: int = 1_000_000


@dataclass
class Tree:
    """cells: unit centres. leaves: unit centres. owner: the cell of each leaf, ascending; first: the first leaf of each cell (one more at the end).
    gain: by how much the best leaf of a cell is usually more similar to a vector than the cell's centre."""

    cells: np.ndarray
    leaves: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    gain: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / n[:, None]).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centres and the centre of each row. Centres that lose all rows are dropped."""
    k = max(1, min(k, len(x)))
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        order = np.argsort(at, kind="stable")
        kept, begin = np.unique(at[order], return_index=True)
        total = np.add.reduceat(x[order], begin, axis=0)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-6, total / np.maximum(norm, 1e-6)[:, None], c[kept]).astype(np.float32)
    return c, (x @ c.T).argmax(1)


def fit_tree(x: np.ndarray, n: int, cfg: TreeConfig) -> Tree:
    """x: unit vectors of the sample; n: vectors in all. Dense regions get leaves in proportion to their part of the sample."""
    rng = np.random.default_rng(cfg.seed)
    leaves = max(1, min(cfg.leaves, math.ceil(n / cfg.leaf), len(x) // 8 or 1))
    cells, at = _kmeans(x, max(1, round(leaves / cfg.per_cell)), rng)
    parts = [_kmeans(x[at == i], max(1, round(leaves * (at == i).mean())), rng)[0] if (at == i).any() else cells[i : i + 1] for i in range(len(cells))]
    sizes = [len(p) for p in parts]
    some, base = x[: 2_048], x[: 2_048] @ cells.T
    gain = np.array([np.quantile((some @ p.T).max(1) - base[:, i], cfg.gain) for i, p in enumerate(parts)], np.float32)
    return Tree(cells, np.concatenate(parts), np.repeat(np.arange(len(cells)), sizes), np.concatenate([[0], np.cumsum(sizes)]), gain)


def leaf_order(tree: Tree, x: np.ndarray, visits: int) -> np.ndarray:
    """For each unit vector the leaves that it visits, in order of visit: best-bin-first through a priority queue.

    The queue's key is the negated similarity, for an unopened cell that of its centre plus what its best leaf usually
    gains on it. The queues of all vectors are held as sorted rows of equal length; the vectors that open the same cell
    next compute its leaves' similarities together. A vector is done when so many leaves precede its next cell.
    """
    n, visits = len(x), min(visits, len(tree.leaves))
    key = -(x @ tree.cells.T) - tree.gain
    order = np.argsort(key, axis=1, kind="stable")
    bound = np.take_along_axis(key, order, axis=1)
    queue, leaf = np.full((n, visits), np.inf, np.float32), np.full((n, visits), -1, np.int32)
    rows = np.arange(n)
    for rank in range(len(tree.cells)):
        cell = order[rows, rank]
        by = np.argsort(cell, kind="stable")
        edge = np.searchsorted(cell[by], np.arange(len(tree.cells) + 1))
        for c in np.flatnonzero(edge[1:] > edge[:-1]):
            mine = rows[by[edge[c] : edge[c + 1]]]
            lo, hi = tree.first[c], tree.first[c + 1]
            keys = np.concatenate([queue[mine], -(x[mine] @ tree.leaves[lo:hi].T)], axis=1)
            names = np.concatenate([leaf[mine], np.broadcast_to(np.arange(lo, hi, dtype=np.int32), (len(mine), hi - lo))], axis=1)
            best = np.argpartition(keys, visits - 1, axis=1)[:, :visits] if keys.shape[1] > visits else np.broadcast_to(np.arange(visits), (len(mine), visits))
            queue[mine], leaf[mine] = np.take_along_axis(keys, best, axis=1), np.take_along_axis(names, best, axis=1)
        if rank + 1 < len(tree.cells):
            rows = rows[queue[rows].max(1) > bound[rows, rank + 1]]
            if not len(rows):
                break
    return np.take_along_axis(leaf, np.argsort(queue, axis=1, kind="stable"), axis=1)


def cells_of(tree: Tree, x: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells that each vector visits, once each."""
    cell = np.sort(tree.owner[leaf_order(tree, x, visits)], axis=1)
    row, at = np.nonzero(np.concatenate([np.ones((len(x), 1), bool), cell[:, 1:] != cell[:, :-1]], axis=1))
    return row, cell[row, at]


def _cell_sets(tree: Tree, x: np.ndarray, visits: int) -> np.ndarray:
    out = np.zeros((len(x), len(tree.cells)), bool)
    out[cells_of(tree, x, visits)] = True
    return out


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def _pack(x: np.ndarray) -> list[bytes]:
    """Lossless: half precision where that holds every value of the row, else single."""
    h = x.astype(np.float16)
    same = (h.astype(np.float32) == x).all(1)
    return [a.tobytes() if s else b.tobytes() for s, a, b in zip(same, h, x, strict=True)]


def _unpack(rows: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(rows), width), np.float32)
    half = np.fromiter((len(r) == 2 * width for r in rows), bool, len(rows))
    if half.any():
        out[half] = np.frombuffer(b"".join(r for r, h in zip(rows, half, strict=True) if h), np.float16).reshape(-1, width)
    if not half.all():
        out[~half] = np.frombuffer(b"".join(r for r, h in zip(rows, half, strict=True) if not h), np.float32).reshape(-1, width)
    return out


class VectorIndex:
    """A fitted tree, its calibrated visits, and two tables in the shared folder: vectors (vid, vec), a row per map task and
    distinct vector, and ids (id, vid), a row per id. vid names a vector by a 64-bit hash of all its values."""

    def __init__(self, df: DataFrame, id_col: str, vector: str, width: int, floor: float, cfg: TreeConfig | None = None, k: int = 5, weakest: bool = False, newest: str | None = None):
        """floor: similarities below it are of no interest. The calibration counts the k best neighbours at or above it, or the k weakest: those that join clusters.

        Rows with a null id, or a vector that is null, of another width, all zero or holding null, NaN or infinity, take
        no part. Of an id with several vectors the newest counts, then the one with the greatest vid.
        """
        self.spark, self.width, self.floor, self.cfg, self.k, self.sign = df.sparkSession, width, floor, cfg or TreeConfig(), k, -1 if weakest else 1
        at = F.col(newest) if newest else F.lit(0)
        right = (F.size(vector) == width) & ~F.exists(vector, lambda v: v.isNull())
        rows = df.where(F.col(id_col).isNotNull() & right).select(F.col(id_col).alias("id"), at.alias("at"), F.xxhash64(vector).alias("vid"), F.col(vector).cast("array<float>").alias("v"))
        kinds = dict(rows.dtypes)

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                x = _rows_of(batch.column(3), width)
                sound = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
                vid = batch.column(2).to_numpy()[sound].tolist()
                if len(seen) > 1_000_000:  # copies pass and are reduced in the cell's task
                    seen.clear()
                fresh = np.array([not (v in seen or seen.add(v)) for v in vid], bool)
                packed = np.full(len(sound), None, object)
                packed[fresh] = _pack(x[sound[fresh]])
                keep = batch.take(pa.array(sound))
                yield pa.RecordBatch.from_arrays([*keep.columns[:3], pa.array(packed.tolist(), pa.binary())], names=["id", "at", "vid", "vec"])

        self.table = cut(rows.mapInArrow(store, f"id {kinds['id']}, at {kinds['at']}, vid bigint, vec binary"), "vectors")
        picked = self.table.groupBy("id").agg(F.max(F.struct("at", "vid")).alias("p"))
        self.ids = cut(picked.select("id", F.col("p.vid").alias("vid")), "vector-ids")
        self.vectors = self.table.where("vec is not null").select("vid", "vec")
        vids = self.ids.select("vid").distinct()
        if newest and not self.table.select("vid").distinct().join(vids, "vid", "left_anti").isEmpty():
            self.vectors = self.vectors.join(vids, "vid", "left_semi")  # vectors that no id has any longer
        self.rows = self.vectors.count()
        self.visits, self.recall = 0, 1.0
        self.populations = np.zeros(0)
        if self.rows:
            self._fit()

    def _fit(self) -> None:
        cfg, width = self.cfg, self.width
        want = min(cfg.sample, self.rows)
        part = min(1.0, 1.2 * (want + cfg.probes) / self.rows + 1e-4)
        # rows are drawn by their hash, so a rerun draws the same; copies of a vector count once
        drawn = self.vectors.where(F.pmod(F.xxhash64("vid", F.lit(cfg.seed)), F.lit(1_000_000)) < int(part * 1_000_000) + 1).toArrow()
        vid, first = np.unique(drawn["vid"].to_numpy(), return_index=True)
        pick = np.random.default_rng(cfg.seed).permutation(len(vid))[: want + cfg.probes]
        x, vid = unit(_unpack(drawn["vec"].take(pa.array(first[pick])).to_pylist(), width)), vid[pick]
        # where the sample is not all rows, the probes are kept out of the fit: a fitted vector draws its leaf's centre to itself
        fitted = min(want, max(len(x) - cfg.probes, (len(x) + 1) // 2)) if self.rows > want else len(x)
        self.tree = fit_tree(x[:fitted], self.rows, cfg)
        asked = slice(fitted, fitted + cfg.probes) if fitted < len(x) else slice(cfg.probes)
        self._calibrate(x[asked], vid[asked])
        _, cell = cells_of(self.tree, x, self.visits)
        self.populations = np.bincount(cell, minlength=len(self.tree.cells)) * (self.rows / len(x))

    def _calibrate(self, queries: np.ndarray, vids: np.ndarray) -> None:
        """Scan all vectors for the best neighbours of the sampled queries; widen the visits until the target is reached."""
        cfg, most = self.cfg, len(self.tree.leaves)
        raw = scanned(self, queries, vids).toArrow()  # at most probes x k rows
        if not raw.num_rows:
            self.visits, self.recall = min(4, most), 1.0
            return
        at = {v: i for i, v in enumerate(vids.tolist())}
        mine = queries[[at[v] for v in raw["vid"].to_pylist()]]
        other = unit(_unpack(raw["vec"].to_pylist(), self.width))
        visits = 1
        while True:
            a, b = (_cell_sets(self.tree, x, visits) for x in (mine, other))
            self.recall = float((a & b).any(1).mean())
            if self.recall >= cfg.target or visits >= most:
                self.visits = min(most, math.ceil(cfg.spare * visits))
                return
            visits = min(most, visits + max(1, visits // 4))

    def _divided(self, sent: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
        """Trees for the cells that outgrow the bound, level by level: (rows with their last cell, (cell, n) of all cells, tables that nothing needs once the rows are read)."""
        cfg, width, visits, rest = self.cfg, self.width, self.visits, sent.columns[1:]
        kinds = ", ".join(f"{c} {k}" for c, k in sent.dtypes)

        def fit(key: tuple, t: pa.Table) -> pa.Table:
            vid, first = np.unique(t["vid"].to_numpy(), return_index=True)
            x = unit(_unpack(t["vec"].take(pa.array(first)).to_pylist(), width))
            # as many leaves as the cell's own size asks for, the sample allowing
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(fit_tree(x, t["n"][0].as_py(), cfg))], pa.binary())})

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, tree = None, None
            for batch in batches:
                keys = batch.column(0).to_numpy()
                edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if a == b:
                        continue
                    some = batch.slice(a, b - a)
                    told = some.column(1).is_valid()
                    if keys[a] != cell:  # a tree comes first, again with each salt
                        cell, tree = keys[a], pickle.loads(some.column(1)[0].as_py())
                    some = some.filter(pc.invert(told))
                    if some.num_rows:
                        x = unit(_unpack(some["vec"].to_pylist(), width))
                        row, to = cells_of(tree, x, visits)
                        with np.errstate(over="ignore"):
                            name = (np.uint64(cell.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + to.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
                        take = pa.array(row)
                        yield pa.RecordBatch.from_arrays([pa.array((name ^ (name >> np.uint64(29))).view(np.int64)), *(some[c].take(take) for c in rest)], names=["cell", *rest])

        rows, settled, before = cut(sent, "cells"), None, None
        spent = [rows]
        for level in range(8):
            sizes = cut(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cfg.refine), "large-cells")
            spent.append(sizes)
            now = sizes.agg(F.count("*"), F.max("n")).first()
            if not now[0] or before is not None and now[1] > 0.8 * before:  # what no tree divides is left to the grid
                break
            before = now[1]
            salts = F.ceil(F.col("n") / cfg.refine).cast("int")
            sampled = rows.join(sizes, "cell").where(F.pmod(F.xxhash64("vid", F.lit(level)), F.col("n")) < cfg.part)
            trees = sampled.select("cell", "vid", "vec", "n").groupBy("cell").applyInArrow(fit, "cell bigint, tree binary")
            trees = trees.join(sizes, "cell").select("cell", "tree", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *[F.lit(None).cast(k).alias(c) for c, k in sent.dtypes[1:]])
            large = rows.join(sizes, "cell").select("cell", F.lit(None).cast("binary").alias("tree"), F.pmod(F.xxhash64("vid", F.lit(level + 100)), salts).cast("int").alias("salt"), *rest)
            small = rows.join(sizes, "cell", "left_anti")
            settled = small if settled is None else settled.unionByName(small)
            both = trees.unionByName(large).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("tree").isNull())
            rows = cut(both.select("cell", "tree", *rest).mapInArrow(route, kinds), "cells")
            spent.append(rows)
            release(self.spark)
        rows = rows if settled is None else settled.unionByName(rows)
        sizes = cut(rows.groupBy("cell").agg(F.count("*").alias("n")), "cell-sizes")
        return rows, sizes, [*spent, sizes]

    def _turns(self) -> list[list[int]]:
        """The cells of each turn: as many as shuffle no more rows than the table has, `turn` at least, but always one. Cells that get trees of their own come last and alone."""
        cfg, room, out, held = self.cfg, max(self.cfg.turn, self.rows), [], 0.0
        sent = self.populations * np.ceil(self.populations / cfg.block)
        for c in np.flatnonzero(self.populations <= cfg.refine).tolist():
            if not out or held + sent[c] > room:
                out.append([])
                held = 0.0
            out[-1].append(c)
            held += sent[c]
        return out + [[c] for c in np.flatnonzero(self.populations > cfg.refine).tolist()]

    def meet(self, work: Callable[..., tuple[np.ndarray, ...]], schema: str, names: list[str], extra: DataFrame | None = None) -> DataFrame:
        """Bring every vector to the cells it visits and apply work to one block of a cell's grid at a time.

        extra: (vid, a number), one row for every vector; the numbers travel along and are work's last argument.
        work(x, vid, side) gets the unit vectors of a block (each vid once); side is 0 in a block on the diagonal, whose
        pairs all count, else 1 or 2: then the pairs across the sides count. It returns the columns of its rows.
        """
        width, visits, cfg = self.width, self.visits, self.cfg
        tree = self.spark.sparkContext.broadcast(self.tree)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, cell = cells_of(tree.value, unit(_unpack(batch.column(1).to_pylist(), width)), visits)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *(c.take(take) for c in batch.columns)], names=["cell", *batch.schema.names])

        def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, cell = cells_of(tree.value, unit(_unpack(batch.column(1).to_pylist(), width)), visits)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int64)))], names=[*batch.schema.names, "cells"])

        rows, kinds = self.vectors, "vid bigint, vec binary"
        if extra is not None:
            rows, kinds = rows.join(extra.toDF("vid", "extra"), "vid").select("vid", "vec", F.col("extra").cast("double")), kinds + ", extra double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def finish() -> pa.RecordBatch:
                t = pa.Table.from_batches(held)
                held.clear()
                vid, at = np.unique(t["vid"].to_numpy(), return_index=True)
                t = t.take(pa.array(at))
                cols = work(unit(_unpack(t["vec"].to_pylist(), width)), vid, t["side"].to_numpy(), *([t["extra"].to_numpy()] if "extra" in t.column_names else []))
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

            at = None
            for batch in batches:
                key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
                edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if a == b:
                        continue
                    if held and tuple(key[a]) != at:
                        yield finish()
                    at = tuple(key[a])
                    held.append(batch.slice(a, b - a))
            if held:
                yield finish()

        def worked(sent: DataFrame, large: DataFrame | None, sizes: np.ndarray, rounds: int = 1, at: int = 0) -> DataFrame:
            """One of several rounds over the blocks of the cells; sizes: of the cells, as far as known."""
            if large is None:
                placed = sent.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), *sent.columns[1:])
            else:
                groups = F.coalesce(F.ceil(F.col("n") / cfg.block), F.lit(1)).cast("int")
                own = sent.join(large, "cell", "left").withColumn("g", groups).withColumn("u", F.pmod(F.xxhash64("vid"), F.col("g")).cast("int"))
                others = F.sequence(F.lit(0), F.col("g") - 1)
                if rounds > 1:
                    others = F.filter(others, lambda o: F.pmod(F.xxhash64("cell", F.least("u", o), F.greatest("u", o)), F.lit(rounds)) == at)
                own = own.withColumn("o", F.explode(others))
                side = F.when(F.col("u") == F.col("o"), 0).when(F.col("u") < F.col("o"), 1).otherwise(2)
                placed = own.select("cell", F.least("u", "o").alias("i"), F.greatest("u", "o").alias("j"), side.alias("side"), *sent.columns[1:])
            # twice as many tasks as blocks, but not for a few rows each
            groups = np.ceil(sizes / cfg.block)
            blocks, n = float((groups * (groups + 1) / 2).sum()) / rounds, float((sizes * groups).sum()) / rounds
            parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(2 * blocks), math.ceil(n / 2_000)))
            return placed.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, schema)

        def beyond(cells: list[int]) -> DataFrame | None:
            found = [(c, int(self.populations[c])) for c in cells if self.populations[c] > cfg.block]
            return F.broadcast(self.spark.createDataFrame(found, "cell bigint, n bigint")) if found else None  # at most a row per cell of the first levels

        turns = self._turns()
        if len(turns) == 1 and self.populations.max() <= cfg.refine:
            return worked(rows.mapInArrow(spread, "cell bigint, " + kinds), beyond(turns[0]), self.populations)
        routed = cut(rows.mapInArrow(visited, kinds + ", cells array<bigint>"), "vectors")
        drop(self.table)
        self.table, self.vectors = routed, routed.select("vid", "vec")
        met = None
        for cells in turns:
            sent = routed.select(F.explode(F.array_intersect("cells", F.array(*[F.lit(c).cast("bigint") for c in cells]))).alias("cell"), *routed.columns[:-1])
            large, sizes, spent = beyond(cells), self.populations[cells], []
            if sizes.max() > cfg.refine:
                sent, large, spent = self._divided(sent)
                sizes = large.toArrow()["n"].to_numpy()  # of the cells within one cell
                large = large.where(F.col("n") > cfg.block)
            rounds = math.ceil(float((sizes * np.ceil(sizes / cfg.block)).sum()) / max(cfg.turn, self.rows))
            for at in range(max(1, rounds if large is not None else 1)):
                met = cut(worked(sent, large, sizes, max(1, rounds), at), "met", met)
                release(self.spark)
            drop(*spent)
        return met

    def close(self) -> None:
        """Delete the tables; nothing may read the index or its results any more."""
        drop(self.table, self.ids)


def scanned(index: VectorIndex, queries: np.ndarray, vids: np.ndarray) -> DataFrame:
    """(vid, other, s, vec): of each query the k best (weakest, as the index says) neighbours at or above the floor, by a scan of all vectors. The queries go to every task."""
    width, floor, k, sign = index.width, index.floor, index.k, index.sign
    probe = index.spark.sparkContext.broadcast((queries, vids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qv = probe.value
        for batch in batches:
            ids, packed = batch.column(0).to_numpy(), batch.column(1)
            for at in range(0, len(ids), 4_096):
                own, x = ids[at : at + 4_096], unit(_unpack(packed.slice(at, 4_096).to_pylist(), width))
                sims = q @ x.T
                sims[qv[:, None] == own[None, :]] = -2
                rank = np.where(sims >= floor - 1e-5, -sign * sims, np.float32(9))
                top = np.argpartition(rank, k + 1, axis=1)[:, : k + 2] if sims.shape[1] > k + 2 else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
                r, c = np.nonzero(np.take_along_axis(sims, top, axis=1) >= floor - 1e-5)
                c = top[r, c]
                s = np.einsum("ij,ij->i", q[r], x[c], dtype=np.float64)
                r, c, s = r[s >= floor], c[s >= floor], s[s >= floor]
                yield pa.RecordBatch.from_arrays([pa.array(qv[r]), pa.array(own[c]), pa.array(s), packed.take(pa.array(c + at))], names=["vid", "other", "s", "vec"])

    hits = index.vectors.mapInArrow(scan, "vid bigint, other bigint, s double, vec binary").repartition("vid").groupBy("vid", "other").agg(F.max("s").alias("s"), F.max("vec").alias("vec"))
    best = Window.partitionBy("vid").orderBy(-sign * F.col("s"), "other")
    return hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def linked(x: np.ndarray, side: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, similarity): the pairs of a block at or above the floor, each once, tile by tile."""
    same = not len(side) or side[0] == 0
    one, two = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    for p in range(0, len(one), 256):  # tiles that stay in the processor's cache
        r = one[p : p + 256]
        own = x[r]
        for q in range(p if same else 0, len(two), 1_024):
            c = two[q : q + 1_024]
            s = own @ x[c].T
            at = np.flatnonzero(s >= floor)
            if not len(at):
                continue
            i, j = np.divmod(at, len(c))
            a, b, s = r[i], c[j], s[i, j]
            if same:
                keep = a < b
                a, b, s = a[keep], b[keep], s[keep]
            yield a, b, s


def exactly(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[a[i : i + 65_536]], x[b[i : i + 65_536]], dtype=np.float64) for i in range(0, len(a), 65_536))])


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of each a with the greatest s, ties by the least last."""
    order = np.lexsort((last, -s, a))
    a, b, s = a[order], b[order], s[order]
    near = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[near], b[near], s[near]


def _top(x: np.ndarray, vid: np.ndarray, side: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, ...]:
    """The k best neighbours at or above the floor that each row has in a block."""
    held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0
    for a, b, s in linked(x, side, floor - 1e-5):
        held += [(a, b, s), (b, a, s)]
        n += 2 * len(a)
        if n > 4_000_000:
            a, b, s = (np.concatenate(c) for c in zip(*held, strict=True))
            held = [_best(a, b, s, b, k + 3)]
            n = len(held[0][0])
    a, b, s = (np.concatenate(c) for c in zip(*held, strict=True))
    a, b, _ = _best(a, b, s, b, k + 3)  # more than k, as these similarities are in single precision
    s = exactly(x, a, b)
    keep = s >= floor
    a, b, s = _best(a[keep], b[keep], s[keep], vid[b[keep]], k)
    return vid[a], vid[b], s


def neighbours(index: VectorIndex) -> DataFrame:
    """(vid, other, similarity, rank): for each distinct vector its k most similar other vectors at or above the index's floor."""
    k, floor = index.k, index.floor
    if not index.rows:
        return index.spark.createDataFrame([], "vid bigint, other bigint, similarity double, rank int")
    found = index.meet(lambda *a: _top(*a, k=k, floor=floor), "vid bigint, other bigint, similarity double", ["vid", "other", "similarity"])
    best = Window.partitionBy("vid").orderBy(F.desc("similarity"), "other")
    return found.repartition("vid").groupBy("vid", "other").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, id_col: str, vector: str, k: int = 5, floor: float = 0.8, width: int = 128, newest: str | None = None, cfg: TreeConfig | None = None) -> DataFrame:
    """(a, b, similarity): pairs a < b of ids with cosine >= floor, one among the k most similar of the other.

    Ids whose vector is null, empty, of another width, all zero or holds null, NaN or infinity take no part; a null id
    neither. Each id counts once. Ties go to the smaller id; of m exact copies each has the k smallest others as its most
    similar, so a group of copies yields at most k rows per member and never all its pairs. No rows give no rows. Columns
    of the input other than those named are not read, so their names cannot clash.
    """
    index = VectorIndex(df, id_col, vector, width, floor, cfg, k, newest=newest)
    ids = index.ids
    if not index.rows:
        return df.sparkSession.createDataFrame([], "a string, b string, similarity double")
    few = Window.partitionBy("vid").orderBy("id")
    # k + 1 ids suffice: a member leaves out itself
    first = ids.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).groupBy("vid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    member = ids.join(first, "vid").select("vid", "id", "ids")
    copies = member.where(F.size("ids") > 1).select("id", F.explode(F.slice(F.filter("ids", lambda i: i != F.col("id")), 1, k)).alias("other"), F.lit(1.0).alias("similarity"))
    near = neighbours(index).join(first.select(F.col("vid").alias("other"), F.col("ids").alias("others")), "other").join(first, "vid")
    ranked = near.where(F.size("ids") <= k).groupBy("vid", "ids").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("d"), F.slice("others", 1, k).alias("o")))).alias("n"))
    flat = F.flatten(F.transform("n", lambda z: F.transform(z["o"], lambda o: F.struct(o.alias("o"), (-z["d"]).alias("s")))))
    listed = ranked.select("ids", F.explode(F.slice(flat, F.lit(1), F.lit(k + 1) - F.size("ids"))).alias("z"))
    across = listed.select(F.explode("ids").alias("id"), F.col("z.o").alias("other"), F.col("z.s").alias("similarity"))
    pairs = copies.unionByName(across).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "similarity")
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def expected_links(index: VectorIndex, queries: DataFrame, block: int = 2_048) -> tuple[DataFrame, int]:
    """((vid, other): what scanned() gives for the queries (vid), their number). The scan is exact and goes over all vectors once per `block` queries, which is also what a task is sent at a time."""
    held = index.vectors.join(queries.select("vid").distinct(), "vid", "left_semi").groupBy("vid").agg(F.max("vec").alias("vec"))
    held = cut(held.select("vid", "vec"), "query-vectors")
    n = held.count()
    blocks = max(1, -(-n // block))
    expected = None
    for b in range(blocks):
        got = held.where(F.pmod(F.xxhash64("vid"), F.lit(blocks)) == b).toArrow()
        if got.num_rows:
            near = scanned(index, unit(_unpack(got["vec"].to_pylist(), index.width)), got["vid"].to_numpy()).select("vid", "other")
            expected = near if expected is None else expected.unionByName(near)
    return expected if expected is not None else index.spark.createDataFrame([], "vid bigint, other bigint"), n


def recall_row(expected: DataFrame, n: int) -> DataFrame:
    """One row (queries, expected, met, recall) of expected rows with `hit`, null where not met; with nothing to expect the recall is null."""
    return expected.agg(F.lit(n).alias("queries"), F.count("*").alias("expected"), F.count("hit").alias("met"), F.try_divide(F.count("hit"), F.count("*")).alias("recall"))


def recall_of(index: VectorIndex, found: DataFrame, queries: DataFrame) -> DataFrame:
    """recall_row of the links that a scan of all vectors gives for the queries (vid), met if found (vid, other) holds them in either direction."""
    expected, n = expected_links(index, queries)
    pairs = found.select(F.least("vid", "other").alias("a"), F.greatest("vid", "other").alias("b")).distinct().withColumn("hit", F.lit(1))
    both = expected.select(F.least("vid", "other").alias("a"), F.greatest("vid", "other").alias("b")).join(pairs, ["a", "b"], "left")
    return recall_row(both, n)
