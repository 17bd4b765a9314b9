"""Tables over file texts (path, text): lines, line matches, ranges, directory trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, line, text): lines numbered from 1."""
    return files.select(path, F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select(path, (F.col("p") + 1).alias("line"), "text")


def match_lines(files: DataFrame, wanted: str, path: str = "path") -> DataFrame:
    """Lines that equal ``wanted`` when both are trimmed."""
    return lines(files, path).where(F.trim("text") == wanted.strip()).select(path, "line")


def read_ranges(files: DataFrame, asked: DataFrame, path: str = "path") -> DataFrame:
    """For (path, start, end), lines from 1, end included: the text, each line with its newline, or an error."""
    all_ = F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)
    n = F.when(F.col("text") == "", 0).otherwise(F.size(all_))
    met = asked.join(files.select(path, F.col("text"), F.lit(True).alias("_there")), path, "left")
    error = (
        F.when(F.col("_there").isNull(), "file_not_found")
        .when(F.col("start") < 1, "start_is_zero")
        .when(F.col("end") < F.col("start"), "end_before_start")
        .when(F.col("start") > n, "start_beyond_end")
        .when(F.col("end") > n, "end_beyond_end")
    )
    met = met.withColumn("error", error)
    body = F.concat(F.array_join(F.slice(all_, F.greatest(F.col("start"), F.lit(1)), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))), "\n"), F.lit("\n"))
    return met.select(*asked.columns, F.when(F.col("error").isNull(), body).alias("chunk"), "error")


def directories(paths: DataFrame, path: str = "path") -> DataFrame:
    """All ancestor directories of the paths, once each."""
    parts = F.split(path, "/")
    up = paths.where(F.contains(F.col(path), F.lit("/"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    return up.distinct()


def directory_edges(dirs: DataFrame) -> DataFrame:
    """(parent, child) of directories; a top-level one has no parent."""
    return dirs.where(F.contains("dir", F.lit("/"))).select(F.regexp_replace("dir", "/[^/]*$", "").alias("parent"), F.col("dir").alias("child"))


def first_prints(shown: DataFrame) -> DataFrame:
    """Of snippet lines (path, place, line), each line once a file, where it comes first."""
    return shown.groupBy("path", "line").agg(F.min("place").alias("place"))
