"""Session helpers: defaults for a local session, and tables written to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "textgrove") -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset (tests on one machine), a temporary folder is set for the session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="textgrove-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, label: str, onto: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor costs no recomputation.

    onto: a table written by cut(), to which the rows are added.
    """
    spark = df.sparkSession
    path = onto._textgrove_path if onto is not None else f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists" if onto is None else "append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textgrove_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by cut() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_textgrove_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended: it does so when the driver collects its garbage."""
    spark._jvm.System.gc()


def prepare(spark: SparkSession) -> SparkSession:
    """Let the Python workers of this session import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (held, root) if p)
    return spark
