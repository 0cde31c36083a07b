"""Exact cosine search: among the children of a node, and of a stated query set against all rows, in blocks; single-linkage clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import dot, unit
from ..session import cut

QUERY_BLOCK = 4_096


def child_topk(children: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """(query_id, parent, id, score, rank): for each query (query_id, parent, q) the k most similar children (parent, id, v) above the threshold.

    Rows without a vector, zero vectors and other widths score null and drop out; ties go to the smaller id.
    """
    queries = queries.select("query_id", "parent", unit("q").alias("q")).where("q is not null")
    children = children.select("parent", "id", unit("v").alias("v")).where("v is not null")
    scored = queries.join(children, "parent").where(F.size("q") == F.size("v")).select("query_id", "parent", "id", dot("v", "q").alias("score")).where(F.col("score") > threshold)
    best = Window.partitionBy("query_id", "parent").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def query_topk(rows: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank) for a stated set of queries (query_id, q) against all other rows (id, v), a block of queries at a time.

    A block has half of QUERY_BLOCK queries on average, so what is sent to all tasks is bounded. A task compares a batch
    of rows with a block in one product and hands on the k best of each query, with those that tie with the last.
    """
    kind = dict(rows.dtypes)["id"]
    blocks = max(1, -(-queries.count() // (QUERY_BLOCK // 2)))
    numbered = cut(queries.select("query_id", unit("q").alias("q")).where("q is not null").withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    name = dict(numbered.dtypes)["query_id"]
    rows = rows.select("id", unit("v").alias("v")).where("v is not null")
    out = None
    for b in range(blocks):
        held = numbered.where(F.col("__b") == b).select("query_id", "q").toArrow()
        sent = rows.sparkSession.sparkContext.broadcast(held)

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = _by_width(sent.value["query_id"], sent.value["q"].combine_chunks())
            for batch in batches:
                for width, (ids, x) in _by_width(batch.column(0), batch.column(1)).items():
                    if width not in asked:
                        continue
                    names, q = asked[width]
                    scores = q @ x.T
                    last = np.partition(scores, -min(k + 1, len(x)), axis=1)[:, -min(k + 1, len(x))]  # one more, for the query itself
                    r, c = np.nonzero((scores >= last[:, None] - 1e-9) & (scores > threshold))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(r)), ids.take(pa.array(c)), pa.array(scores[r, c])], names=["query_id", "id", "score"])

        top = rows.mapInArrow(best, f"query_id {name}, id {kind}, score double").where("id <> query_id")
        out = top if out is None else out.unionByName(top)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_width(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[pa.Array, np.ndarray]]:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    widths = vectors.value_lengths().to_numpy()
    out = {}
    for w in np.unique(widths).tolist():
        of = pa.array(np.flatnonzero(widths == w))
        out[w] = (ids.take(of), vectors.take(of).flatten().to_numpy(zero_copy_only=False).reshape(-1, w))
    return out


def linked_pairs(vectors: DataFrame, floor: float, block: int = 2_048) -> DataFrame:
    """(a, b): ids a < b with cosine above floor, compared exactly, block by block.

    Each pair of blocks is one task's work and only links leave it. The work is that of all pairs, as the definition of
    the clustering asks; it serves entity sets, not corpora. Vectors that are null, empty or zero have no links.
    """
    rows = vectors.where("id is not null and size(v) > 0").groupBy("id").agg(F.first("v").alias("v"))
    n = rows.count()
    blocks = max(1, -(-n // block))
    at = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    placed = rows.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.withColumn("i", F.least("at", "other")).withColumn("j", F.greatest("at", "other"))

    def links(t: pa.Table) -> pa.Table:
        ids, at = t["id"].to_numpy(), t["at"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        widths = t["v"].combine_chunks().value_lengths().to_numpy()
        out_a, out_b = [], []
        for w in np.unique(widths):
            of = np.flatnonzero(widths == w)
            x = np.array(t["v"].take(pa.array(of)).to_pylist(), np.float64).reshape(len(of), w)
            size = np.linalg.norm(x, axis=1)
            ok = size > 0
            x, of = x[ok] / size[ok][:, None], of[ok]
            p, q = np.flatnonzero(at[of] == i), np.flatnonzero(at[of] == j)
            for s in range(0, len(p), 1_024):
                r, c = np.nonzero(x[p[s : s + 1_024]] @ x[q].T > floor)
                a, b = ids[of[p[s : s + 1_024]][r]], ids[of[q][c]]
                keep = a < b if i == j else np.ones(len(a), bool)
                out_a.append(np.minimum(a, b)[keep])
                out_b.append(np.maximum(a, b)[keep])
        none = np.zeros(0, ids.dtype)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    kind = dict(rows.dtypes)["id"]
    return placed.select("id", "v", "at", "i", "j").groupBy("i", "j").applyInArrow(links, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(v, part): connected parts of the edges (a, b), named by their least vertex.

    Every round each vertex takes the least label around it and then its label's label, so labels travel in doubling
    steps; rounds are cut by written tables.
    """
    near = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = cut(near.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("part")), "labels")
    while True:
        around = near.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("part").alias("seen"))
        lower = labels.join(around, "v").select("v", F.least("part", "seen").alias("part"), F.col("part").alias("was"))
        jump = lower.select(F.col("v").alias("part"), F.col("part").alias("further"))
        nxt = cut(lower.join(jump, "part", "left").select("v", F.least("part", F.coalesce("further", "part")).alias("part"), "was"), "labels")
        if nxt.where("part <> was").isEmpty():
            return nxt.select("v", "part")
        labels = nxt.select("v", "part")


def single_linkage(vectors: DataFrame, distance: float = 0.25, block: int = 2_048) -> DataFrame:
    """(id, part) for vectors (id, v): ids joined by cosine distances below `distance`, directly or through others; an id without links is its own part."""
    parts = components(linked_pairs(vectors, 1 - distance, block))
    return vectors.where("id is not null").select("id").distinct().join(parts.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("part", "id").alias("part"))

