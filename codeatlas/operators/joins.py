"""Resolution joins: precedence, nearest ancestor, innermost interval, most specific prefix, anti and semi joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_precedence(keys: list[str], candidates: list[DataFrame], order: list[Column]) -> DataFrame:
    """The candidate of the earliest list for each key (``precedence`` tells which list it came from)."""
    ranked = [c.withColumn("precedence", F.lit(i)) for i, c in enumerate(candidates)]
    return first_by(reduce(DataFrame.unionByName, ranked), keys, [F.col("precedence"), *order])


def parent_child(defs: DataFrame, rules: DataFrame, sep: str = ".") -> DataFrame:
    """Edges from a definition to the one its fqn extends by one part in the same file, typed by rules (parent_type, child_type, rel_type)."""
    parts = F.split("fqn", f"\\Q{sep}\\E")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), sep)
    child = defs.select(F.col("id").alias("target_id"), parent.alias("p_fqn"), F.col("primary_file_path").alias("p_file"), F.col("definition_type").alias("child_type")).where(F.col("p_fqn") != "")
    up = defs.select(F.col("id").alias("source_id"), F.col("fqn").alias("p_fqn"), F.col("primary_file_path").alias("p_file"), F.col("definition_type").alias("parent_type"))
    return child.join(up, ["p_fqn", "p_file"]).join(rules, ["parent_type", "child_type"]).select("source_id", "target_id", F.col("rel_type").alias("type"))


def nearest_ancestor(defs: DataFrame, rules: DataFrame, sep: str = "::") -> DataFrame:
    """Like ``parent_child`` with the longest prefix that has a valid type pair; the same file is preferred."""
    parts = F.split("fqn", f"\\Q{sep}\\E")
    child = defs.withColumn("_p", parts).where(F.size("_p") > 1).select(
        F.col("id").alias("target_id"), F.col("primary_file_path").alias("c_file"), F.col("definition_type").alias("child_type"), "_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("depth")
    )
    child = child.withColumn("p_fqn", F.array_join(F.slice("_p", 1, F.col("depth")), sep)).drop("_p")
    up = defs.select(F.col("id").alias("source_id"), F.col("fqn").alias("p_fqn"), F.col("primary_file_path").alias("p_file"), F.col("definition_type").alias("parent_type"))
    met = child.join(up, "p_fqn").join(rules, ["parent_type", "child_type"])
    best = first_by(met, ["target_id"], [F.col("depth").desc(), (F.col("p_file") == F.col("c_file")).desc(), F.col("source_id")])
    return best.select("source_id", "target_id", F.col("rel_type").alias("type"), "depth")


def innermost(points: DataFrame, ranges: DataFrame, key: str, at: str = "offset", start: str = "start", end: str = "end") -> DataFrame:
    """For each point the smallest range of its key that holds it (ties: the earlier, then the least range).

    Equi join on the key, range test as residual. A place is judged once, however many points stand there; the
    points, null places too, only meet the findings.
    """
    r = ranges.select(F.col(key), F.struct(*ranges.columns).alias("range"))
    met = points.select(key, at).distinct().join(r, key).where((F.col(f"range.{start}") <= F.col(at)) & (F.col(at) <= F.col(f"range.{end}")))
    order = F.struct(F.col(f"range.{end}") - F.col(f"range.{start}"), F.col(f"range.{start}"), F.col("range"))
    return points.join(met.groupBy(key, at).agg(F.min_by("range", order).alias("range")), [key, at]).select(*points.columns, "range")


def most_specific(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the longest root it lies under, by exploding its ancestors into an equi join."""
    parts = F.split(path, "/")
    up = paths.withColumn("_d", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn(root, F.array_join(F.slice(parts, 1, F.col("_d")), "/"))
    return first_by(up.join(roots, root), [path], [F.col("_d").desc()]).drop("_d")


def resolve_ids(edges: DataFrame, source: DataFrame, target: DataFrame, source_key: list[str], target_key: list[str]) -> DataFrame:
    """Edges named by natural keys (s_*, t_*) get the ids of their nodes; edges without both nodes go."""
    s = source.select(F.col("id").alias("source_id"), *[F.col(c).alias(f"s_{c}") for c in source_key])
    t = target.select(F.col("id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in target_key])
    return edges.join(s, [f"s_{c}" for c in source_key]).join(t, [f"t_{c}" for c in target_key])


def unresolved(edges: DataFrame, nodes: DataFrame, prefix: str, key: list[str]) -> DataFrame:
    """The edges whose node isn't there, for diagnostics."""
    return edges.join(nodes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in key]), [f"{prefix}_{c}" for c in key], "left_anti")


def latest(defs: DataFrame, imports: DataFrame) -> DataFrame:
    """Of definitions and imports (name, file, start_byte, id), the one of a name that starts last; ties go to the definition."""
    both = defs.select("name", "file", "start_byte", "id", F.lit("definition").alias("kind")).unionByName(imports.select("name", "file", "start_byte", "id", F.lit("import").alias("kind")))
    return first_by(both, ["name", "file"], [F.col("start_byte").desc(), "kind", "id"])
