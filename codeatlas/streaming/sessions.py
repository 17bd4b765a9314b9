"""Debounced file events, job queues with priorities, and the loop that applies changes.

All functions take batch or streaming DataFrames; for a stream the watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Path components whose changes are ignored.
IGNORED = [".git", ".idea", ".vscode", ".cache"]


def file_events(events: DataFrame) -> DataFrame:
    """(ts, project, path) rows of the ``events`` table."""
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("project"), F.col("event_type").alias("path"))


def not_ignored(events: DataFrame) -> DataFrame:
    return events.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(c) for c in IGNORED])))


def debounce(events: DataFrame, gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """(project, start, end, n, paths): bursts of a project's events that no pause of ``gap`` divides."""
    rows = not_ignored(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    w = rows.groupBy("project", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("path")).alias("paths"))
    return w.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "paths")


def preempt(jobs: DataFrame) -> DataFrame:
    """(id, workspace, kind, ts, priority) with status: jobs waiting when a High one of their kind comes are cancelled."""
    high = F.max(F.when(F.col("priority") == "High", F.col("ts"))).over(Window.partitionBy("workspace", "kind"))
    return jobs.withColumn("status", F.when((F.col("priority") != "High") & (F.col("ts") < high), "Cancelled").otherwise("Pending"))


def queue_order(jobs: DataFrame) -> DataFrame:
    """The place of each pending job in its workspace's queue, first come first served."""
    return jobs.where(F.col("status") == "Pending").withColumn("place", F.row_number().over(Window.partitionBy("workspace").orderBy("ts", "id")))


def apply_changes(bursts: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``apply`` on each micro-batch of bursts, one at a time, exactly once with an idempotent ``apply``."""
    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
