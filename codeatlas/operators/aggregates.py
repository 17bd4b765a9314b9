"""Counts, statistics, roll-ups and evaluation metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..schema import DEFINITION, DIRECTORY, FILE, IMPORT, RELS

AGGREGATES = {"count", "max", "min", "sum", "avg"}


def scalar(df: DataFrame, function: str, column: str) -> DataFrame:
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate {function}")
    return df.agg(F.expr(f"{function}(`{column}`)").alias("value"))


def counts_row(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each part, in one job."""
    marked = [d.select(*[F.lit(1 if n == m else 0).alias(m) for m in parts]) for n, d in parts.items()]
    return reduce(DataFrame.unionByName, marked).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in parts])


def node_counts(g: PropertyGraph) -> DataFrame:
    return counts_row({"directories": g.scan(DIRECTORY), "files": g.scan(FILE), "definitions": g.scan(DEFINITION), "imported_symbols": g.scan(IMPORT)})


def relationship_counts(g: PropertyGraph) -> DataFrame:
    """Edges of each table, counted directed, with their total."""
    row = counts_row({t.split("_REL")[0].lower(): g.table(t).select("source_id") for t in dict.fromkeys(r.table for r in RELS)})
    return row.withColumn("total", reduce(Column.__add__, [F.col(c) for c in row.columns]))


def count_by_type(g: PropertyGraph, name: str) -> DataFrame:
    return g.table(name).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def distinct_pairs(edges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (from label, source, to label, target), nulls included."""
    return edges.groupBy(*by).agg(F.count_distinct(F.struct("from_label", "source_id", "to_label", "target_id")).alias("pairs"))


def language_breakdown(g: PropertyGraph) -> DataFrame:
    """(language, files, definitions, types): the types as a map from definition type to count."""
    files = g.scan(FILE)
    per = g.scan(DEFINITION).join(files.select(F.col("path").alias("primary_file_path"), "language"), "primary_file_path").groupBy("language", "definition_type").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("language").agg(F.sum("n").alias("definitions"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("definition_type", "n")))).alias("types"))
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files")).join(maps, "language", "left").withColumn("definitions", F.coalesce("definitions", F.lit(0)))


def roll_up(long_form: DataFrame, keys: list[str]) -> DataFrame:
    """Merge per-project counts (.., key, n) into totals; the long form is summed, not the maps."""
    return long_form.groupBy(*keys).agg(F.sum("n").alias("n"))


def status_roll_up(projects: DataFrame, key: str) -> DataFrame:
    """error > indexing > reindexing > all indexed > pending; the latest index time."""
    has = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(has("error"), "error").when(has("indexing"), "indexing").when(has("reindexing"), "reindexing").when(F.bool_and(F.col("status") == "indexed"), "indexed").otherwise("pending")
    return projects.groupBy(key).agg(status.alias("status"), F.max("last_indexed_at").alias("last_indexed_at"))


def group_references(refs: DataFrame) -> DataFrame:
    """Call lines by referencing definition and range, sorted."""
    key = F.concat(F.col("fqn"), F.lit(":L"), (F.col("start_line") + 1).cast("string"), F.lit("-"), (F.col("end_line") + 1).cast("string"))
    return refs.groupBy(key.alias("reference")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("call_line")).alias("lines"))


def mean_over(df: DataFrame, key: str, value: str, sessions: int) -> DataFrame:
    """Means with a missing key as 0: the denominator is the number of sessions."""
    return df.groupBy(key).agg((F.sum(value) / sessions).alias("mean"))


def shares(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Share in percent, and log10(percent + 1) normalised to 1, of each key."""
    total = counts.agg(F.sum(n).alias("_t"))
    p = counts.join(F.broadcast(total)).withColumn("percent", F.col(n) * 100.0 / F.col("_t")).withColumn("_l", F.log10(F.col("percent") + 1))
    whole = p.agg(F.sum("_l").alias("_w"))
    return p.join(F.broadcast(whole)).select(key, n, "percent", (F.col("_l") / F.col("_w")).alias("log_share"))


def rates(df: DataFrame, flags: list[str], key: str | None = None) -> DataFrame:
    """Percentages of rows with each flag, one decimal."""
    aggs = [F.round(F.sum(F.when(F.col(f), 1).otherwise(0)) * 100.0 / F.count(F.lit(1)), 1).alias(f"{f}_rate") for f in flags]
    return (df.groupBy(key) if key else df.groupBy()).agg(*aggs)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def bucket_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """A quantile from cumulative histogram buckets (le, n), linear within the bucket."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("le")
    b = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0)))
    b = b.withColumn("want", F.max("n").over(Window.partitionBy(*keys)) * q).where((F.col("n") >= F.col("want")) & (F.col("before") < F.col("want")))
    value = F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("before")) / (F.col("n") - F.col("before"))
    return b.select(*keys, value.alias("value"))
