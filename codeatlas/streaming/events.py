"""Progress events of indexing as rows, listeners that record them, and cancellation by tag."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "at timestamp, family string, phase string, workspace string, project string, message string"
FAMILIES = ("workspace_indexing", "project_indexing", "workspace_reindexing", "project_reindexing")
PHASES = ("started", "completed", "failed")


class EventLog:
    """An append-only table of events; each ``emit`` adds one small file, ``compact`` rewrites them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def emit(self, family: str, phase: str, workspace: str, project: str = "", message: str = "") -> None:
        if family not in FAMILIES or phase not in PHASES:
            raise ValueError(f"unknown event {family} {phase}")
        row = (datetime.now(UTC).replace(tzinfo=None), family, phase, workspace, project, message)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def record(self, family: str, workspace: str, project: str = ""):
        """Started, then completed or failed with the error."""
        self.emit(family, "started", workspace, project)
        try:
            yield
        except Exception as e:
            self.emit(family, "failed", workspace, project, str(e)[:1000])
            raise
        self.emit(family, "completed", workspace, project)

    def stream(self, most: int = 1024) -> DataFrame:
        """The events as they come, at most ``most`` files of them in a micro-batch."""
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", most).parquet(self.path)

    def latest(self) -> DataFrame:
        """The last event of each project."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.groupBy("workspace", "project").agg(F.max_by(F.struct("family", "phase", "message", "at"), F.struct("at", "phase")).alias("e")).select("workspace", "project", "e.*")


class Progress(StreamingQueryListener):
    """Calls ``tell(phase, message)`` as streaming queries start, progress and end."""

    def __init__(self, tell: Callable[[str, str], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell("started", str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.tell("progress", f"{event.progress.id} batch {event.progress.batchId} rows {event.progress.numInputRows}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.tell("idle", str(event.id))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("failed" if event.exception else "completed", str(event.exception or event.id))


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs inside carry ``tag``; ``cancel(spark, tag)`` from elsewhere interrupts them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    return spark.interruptTag(tag)
