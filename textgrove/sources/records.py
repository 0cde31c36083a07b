"""What a run leaves beside its tables: a log, its progress, and folders named by time."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession


def logger(folder: str, name: str = "textgrove", now: datetime | None = None) -> logging.Logger:
    """A logger of level INFO that writes to the console and to a file named by the time; a second call adds nothing."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(logging.INFO)
        Path(folder).mkdir(parents=True, exist_ok=True)
        shape = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
        for handler in (logging.StreamHandler(), logging.FileHandler(Path(folder) / f"{stamp(now)}.log", encoding="utf-8")):
            handler.setFormatter(shape)
            log.addHandler(handler)
    return log


def stamp(now: datetime | None = None) -> str:
    """Year to second, as folders of results are named: 20240131_235959."""
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


@contextmanager
def progress(spark: SparkSession, tell: Callable[[int, int], None], every: float = 1.0) -> Iterator[None]:
    """Call tell(tasks done, tasks in all) of the running stages from time to time, and once at the end."""
    over = threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def count() -> tuple[int, int]:
        stages = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def watch() -> None:
        while not over.wait(every):
            tell(*count())

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        tell(*count())
