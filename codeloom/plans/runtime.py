"""Running plans: time limits, scheduling classes, phase metrics."""

from __future__ import annotations

import resource
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
#: Scheduler pools, most urgent first; a cluster gives them weights in its fair-scheduler file.
POOLS = ("admin", "interactive_read", "background_write")


def within(spark: SparkSession, seconds: float, work: Callable[[], T], pool: str = "interactive_read") -> T:
    """``work()`` in a scheduler pool; its Spark jobs are cancelled and TimeoutError raised if it takes longer."""
    if pool not in POOLS:
        raise ValueError(f"pool must be one of {POOLS}")
    group = f"codeloom-{uuid.uuid4().hex[:8]}"
    out: list = []

    def run() -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        spark.sparkContext.setJobGroup(group, pool, interruptOnCancel=True)
        try:
            out.append((work(), None))
        except Exception as e:  # handed to the caller below
            out.append((None, e))

    thread = InheritableThread(target=run, session=spark)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        raise TimeoutError(f"more than {seconds} seconds")
    value, error = out[0]
    if error is not None:
        raise error
    return value


class Phases:
    """Seconds, rows and peak memory of named phases, in the order they ran."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float, int, float]] = []

    @contextmanager
    def phase(self, name: str) -> Iterator[dict]:
        """``with phases.phase("parse") as p: p["rows"] = n``."""
        note: dict = {"rows": 0}
        began = time.monotonic()
        try:
            yield note
        finally:
            self.rows.append((name, time.monotonic() - began, int(note["rows"]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "phase string, seconds double, rows long, peak_mb double")

    def total_rows(self) -> int:
        return sum(r[2] for r in self.rows)
