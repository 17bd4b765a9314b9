"""Evaluation sessions from JSON lines, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "session_id string, passed boolean, timed_out boolean, patch string, cost double, seconds double, "
    "tokens struct<input:long,output:long,reasoning:long,cache_read:long,cache_write:long>, tool_calls map<string,long>"
)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def totals(sessions: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.sum(f"tokens.{t}"), F.lit(0)).alias(t) for t in ("input", "output", "reasoning", "cache_read", "cache_write")]
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), *parts, F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def mean_tool_calls(sessions: DataFrame) -> DataFrame:
    """Mean calls of each tool over all sessions; a session without the tool counts as 0."""
    n = sessions.agg(F.count(F.lit(1)).alias("_n"))
    each = sessions.select(F.explode("tool_calls").alias("tool", "calls")).groupBy("tool").agg(F.sum("calls").alias("calls"))
    return each.join(F.broadcast(n)).select("tool", "calls", (F.col("calls") / F.col("_n")).alias("mean"))  # n is one row


def patch_paths(sessions: DataFrame) -> DataFrame:
    """(session_id, path): the files that a session's patch touches."""
    return sessions.select("session_id", F.explode(F.array_distinct(F.regexp_extract_all("patch", F.lit(r"(?m)^diff --git a/(\S+) b/"), 1))).alias("path"))
