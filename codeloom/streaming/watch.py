"""Watching for changes with Structured Streaming: batches of changes, debounced, each handled once at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions import graph


def debounce(changes: DataFrame, quiet: str = "300 milliseconds", late: str | None = None) -> DataFrame:
    """(root, first_ts, last_ts, n, paths): changes of a root with less than ``quiet`` between them are one batch.

    ``changes`` has root, path, ts, of a batch or a stream; streams need ``late``, how long
    late changes are waited for.  Paths are distinct and sorted.
    """
    rows = changes if late is None else changes.withWatermark("ts", late)
    g = rows.groupBy("root", F.session_window("ts", quiet))
    return g.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths")).drop("session_window")


def change_events(spark: SparkSession, folder: str, schema: str = "root string, path string, ts timestamp") -> DataFrame:
    """A stream of change records written to a folder as JSON lines."""
    return spark.readStream.schema(schema).json(folder).where(~graph.is_ignored(F.col("path")))


def watch(changes: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = "300 milliseconds") -> StreamingQuery:
    """Call ``reindex(paths, batch)`` for each micro-batch's distinct (root, path).

    Micro-batches never overlap; what arrives during one is put together into the next.
    A batch that fails is run again after a restart, from the checkpoint.  Without a
    trigger the stream handles what is there and ends.
    """

    def handle(batch: DataFrame, number: int) -> None:
        reindex(batch.select("root", "path").distinct(), number)

    writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()
