"""Files of a corpus: benchmark JSON, text files, cached tables, and result files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import newlines

BENCHMARK = "tests array<struct<query: string, snippets: array<struct<file_path: string, span: array<int>>>, tags: array<string>>>"


def read_benchmark(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tests, snippets) of benchmark files, each one JSON object with a list `tests`; test_id is the place in the list.

    A file of another shape fails the read. With a name, all tags become that name.
    """
    raw = spark.read.schema(BENCHMARK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    tests = raw.select(F.posexplode("tests").alias("test_id", "t")).select(F.col("test_id").cast("bigint").alias("test_id"), "t.*")
    tags = F.array(F.lit(name)) if name else F.coalesce("tags", F.array().cast("array<string>"))
    span = F.struct(F.get("s.span", F.lit(0)).alias("start"), F.get("s.span", F.lit(1)).alias("end"))
    snippets = tests.select("test_id", F.posexplode("snippets").alias("pos", "s")).select("test_id", "pos", "s.file_path", span.alias("span"))
    return tests.select("test_id", "query", tags.alias("tags")), snippets


def read_corpus(spark: SparkSession, root: str, used: DataFrame | None = None) -> DataFrame:
    """(file_path, content) of the UTF-8 text files under root, line ends as LF; only those named by used(file_path) if given.

    file_path is relative to root. A file is one row and is read whole; files of no bytes
    are left out by Spark's listing and have none.
    """
    base = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).text(base, wholetext=True)
    path = F.regexp_replace("_metadata.file_path", "^.*?/" + re.escape(base.rsplit("/", 1)[-1]) + "/", "")
    rows = files.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("file_path"), newlines("value").alias("content"))
    return rows.join(used.select("file_path").distinct(), "file_path", "left_semi") if used is not None else rows


def cached(spark: SparkSession, path: str, make, use_cache: bool = True) -> DataFrame:
    """The table at path if it can be read, else make() written there; path should name the inputs by a fingerprint."""
    if use_cache:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(df: DataFrame, *columns: str) -> str:
    """A name for the contents of a table: row order plays no part."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0))).first()
    return f"{row[0]}-{row[1]}"


def write_results(scores: DataFrame, hits: DataFrame, summary: DataFrame, path: str) -> None:
    """results: a JSON line per test with its hits; summary: the averages, one JSON object."""
    listed = hits.groupBy("test_id").agg(F.sort_array(F.collect_list(F.struct("place", "file_path", "s", "e", "score"))).alias("retrieved"))
    scores.join(listed, "test_id", "left").write.mode("overwrite").json(f"{path}/results.json")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary.json")

