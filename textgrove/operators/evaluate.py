"""Ground truth, retrieved snippets, and their overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import seeded_draw
from ..sources.tables import read_right_way


def spans(df: DataFrame, *keep: str) -> DataFrame:
    """Distinct rows with s and e in the right order; rows without a file or a span are left out."""
    s, e = read_right_way()
    return df.select(*keep, "file_path", s.alias("s"), e.alias("e")).where("file_path is not null and s is not null").distinct()


def disjointness(snippets: DataFrame) -> DataFrame:
    """Snippets that overlap or touch the one before them in the same test and file."""
    by = Window.partitionBy("test_id", "file_path").orderBy("s", "e", "pos")
    return spans(snippets, "test_id", "pos").withColumn("before", F.lag("e").over(by)).where("before >= s")


def require_disjoint(snippets: DataFrame) -> DataFrame:
    """snippets, if none of one test and file overlap or touch, else ValueError with the first violation."""
    bad = disjointness(snippets).limit(1).collect()
    if bad:
        raise ValueError(f"snippets of test {bad[0]['test_id']} in {bad[0]['file_path']} overlap or touch at {bad[0]['s']}")
    return snippets


def rank_scores(hits: DataFrame) -> DataFrame:
    """(test_id, place, file_path, s, e, score): hits in order of rank, scored 1 / place. Repeated rows count once."""
    by = Window.partitionBy("test_id").orderBy("rank", "file_path", "s", "e")
    placed = spans(hits, "test_id", "rank").withColumn("place", F.row_number().over(by))
    return placed.select("test_id", "place", "file_path", "s", "e", (F.lit(1.0) / F.col("place")).alias("score"))


def overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(test_id, file_path, s, e, fs, fe, shared): pairs of a true and a found span of the same test and file that share text."""
    t, f = spans(truth, "test_id"), spans(found, "test_id").withColumnsRenamed({"s": "fs", "e": "fe"})
    shared = F.least("e", "fe") - F.greatest("s", "fs")
    return t.join(f, ["test_id", "file_path"]).withColumn("shared", shared).where("shared > 0")


def precision_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(test_id, precision, recall) of every test with a true or a found span.

    precision is the shared length by the found length, recall by the true length, 0 where that is 0. Equal spans of a
    test count once; found spans that overlap each other count each.
    """
    both = overlaps(truth, found).groupBy("test_id").agg(F.sum("shared").alias("shared"))
    size = lambda df, name: spans(df, "test_id").groupBy("test_id").agg(F.sum(F.col("e") - F.col("s")).alias(name))
    all_ = size(truth, "true_len").join(size(found, "found_len"), "test_id", "full").join(both, "test_id", "left")
    part = lambda n: F.when(F.col(n) > 0, F.coalesce("shared", F.lit(0)) / F.col(n)).otherwise(F.lit(0.0))
    return all_.select("test_id", part("found_len").alias("precision"), part("true_len").alias("recall"))


def weighted_mean(scores: DataFrame, weight=None) -> DataFrame:
    """One row: average precision and recall, weighted (all 1 unless given); null for no tests."""
    w = weight if weight is not None else F.lit(1.0)
    total = F.sum(w)
    mean = lambda c: F.when(total > 0, F.sum(w * F.col(c)) / total)
    return scores.agg(mean("precision").alias("average_precision"), mean("recall").alias("average_recall"))


def seeded_cap(tests: DataFrame, snippets: DataFrame, most: int = 194) -> DataFrame:
    """At most `most` tests, in the order of a draw seeded by the path of their first snippet; fewer keep their order.

    Tests of one file draw alike and stay in the order of their ids. Tests without snippets are left out.
    """
    first = snippets.where("file_path is not null").groupBy("test_id").agg(F.min_by("file_path", "pos").alias("path"))
    drawn = tests.join(first, "test_id").withColumn("draw", seeded_draw("path"))
    return drawn.orderBy("draw", "test_id").limit(most)
