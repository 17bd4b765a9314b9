"""Incremental maintenance: change classification, diffs, detach-delete, upserts and staged swaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import is_directory_like
from .graph import PropertyGraph, load, save
from .operators.closure import cut
from .schema import DEFINITION, DIRECTORY, FILE, IMPORT, NATURAL_KEYS, RELS


def classify_status(status: DataFrame) -> DataFrame:
    """(path, code) of a version-control status -> (path, change, kind)."""
    change = F.when(F.contains("code", F.lit("D")), "deleted").when(F.contains("code", F.lit("A")) | (F.col("code") == "??"), "added").otherwise("modified")
    return status.select("path", change.alias("change"), F.when(is_directory_like(F.col("path")), "dir").otherwise("file").alias("kind"))


def classify_watched(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Watched (path) against what exists, (path, is_dir): changed with its kind, or deleted."""
    met = paths.distinct().join(listing.select("path", "is_dir"), "path", "left")
    kind = F.when(F.coalesce("is_dir", is_directory_like(F.col("path"))), "dir").otherwise("file")
    return met.select("path", F.when(F.col("is_dir").isNull(), "deleted").otherwise("changed").alias("change"), kind.alias("kind"))


def detach_delete(g: PropertyGraph, label: str, ids: DataFrame) -> PropertyGraph:
    """The graph without the nodes (id) of a label and without their edges; ``ids`` may be empty."""
    gone = ids.select("id").distinct()
    nodes = dict(g.nodes)
    nodes[label] = g.scan(label).join(gone, "id", "left_anti")
    edges = {}
    for rel, df in g.edges.items():
        if rel.source == label:
            df = df.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
        if rel.target == label:
            df = df.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        edges[rel] = df
    return PropertyGraph(g.spark, nodes, edges)


def upsert(old: DataFrame, new: DataFrame, deleted: DataFrame | None, key: list[str]) -> DataFrame:
    """``old`` without deleted keys and with the rows of ``new`` in place of those of their keys."""
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def assign_ids(new: DataFrame, existing: DataFrame, label: str) -> DataFrame:
    """Ids for nodes: what a natural key has already, else numbers from max(id) + 1 in the order of the keys.

    Numbers are dealt by range partition and offset, so no task orders all rows.
    """
    key = NATURAL_KEYS[label]
    known = new.join(existing.select("id", *key).dropDuplicates(key), key, "left")
    head = existing.agg(F.coalesce(F.max("id") + 1, F.lit(1)).alias("head")).first()["head"]
    fresh = known.where(F.col("id").isNull()).drop("id").dropDuplicates(key)
    dealt = fresh.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_p", F.spark_partition_id())
    # a table: rows and sizes must come from one dealing, and another sample could cut the ranges elsewhere
    numbered = cut(dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*key))))
    sizes = numbered.groupBy("_p").agg(F.max("_n").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))  # a row a partition
    out = numbered.join(F.broadcast(offsets), "_p").withColumn("id", F.lit(head) + F.col("_before") + F.col("_n") - 1)
    return known.where(F.col("id").isNotNull()).select("id", *new.columns).unionByName(out.select("id", *new.columns))


def diff(existing: DataFrame, new: DataFrame, key: list[str], changed: DataFrame, path: str) -> DataFrame:
    """Rows of changed files (path) that their new version lacks."""
    return existing.join(changed.select(F.col("path").alias(path)), path, "left_semi").join(new.select(*key), key, "left_anti")


def apply(g: PropertyGraph, changed: DataFrame, deleted: DataFrame, fresh: PropertyGraph) -> PropertyGraph:
    """The graph after files changed or went: nodes of touched files are replaced, their edges follow.

    ``fresh`` holds the nodes and edges extracted from changed files, under the ids that ``assign_ids`` gave.
    Edges into touched files from others stay where their target's natural key is still there.
    """
    touched = changed.select("path").unionByName(deleted.select("path")).distinct()
    out = g
    for label, column in ((DEFINITION, "primary_file_path"), (IMPORT, "file_path"), (FILE, "path")):
        old = g.scan(label).join(touched.select(F.col("path").alias(column)), column, "left_semi")
        out = detach_delete(out, label, old.join(fresh.scan(label).select("id"), "id", "left_anti").select("id"))
    nodes = {label: upsert(out.scan(label), fresh.scan(label), None, ["id"]) for label in (FILE, DEFINITION, IMPORT)}
    nodes[DIRECTORY] = upsert(out.scan(DIRECTORY), fresh.scan(DIRECTORY), None, NATURAL_KEYS[DIRECTORY])
    again = {label: fresh.scan(label).select("id") for label in (DEFINITION, FILE)}
    edges = {}
    for rel in RELS:
        kept = out.rel(rel)
        if rel.source in again:  # what starts in a touched file was extracted anew
            kept = kept.join(again[rel.source].withColumnRenamed("id", "source_id"), "source_id", "left_anti")
        edges[rel] = kept.unionByName(fresh.rel(rel).select(*kept.columns)).dropDuplicates(["source_id", "target_id", "type", "edge_id"])
    return PropertyGraph(g.spark, nodes, edges)


class Store:
    """Versions of a graph under one folder, numbered; the newest one whose write has ended is current.

    A version's marker is made by one rename after all its tables are there, and nothing is deleted before, so a
    reader or a crash at any time finds either the old or the new graph whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, prefix: str) -> list[str]:
        fs, at = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix)) if fs.exists(at) else []

    def current(self) -> str | None:
        done = self._names("done-")
        return done[-1].removeprefix("done-") if done else None

    def read(self) -> PropertyGraph:
        version = self.current()
        return load(self.spark, f"{self.path}/{version}") if version else PropertyGraph(self.spark, {})

    def commit(self, g: PropertyGraph) -> str:
        last = self.current()
        version = f"v-{int(last.split('-')[1]) + 1 if last else 1:012d}-{uuid.uuid4().hex[:8]}"
        save(g, f"{self.path}/{version}")
        staged = f"{self.path}/staged-{version}"
        fs, at = self._fs(staged)
        fs.mkdirs(at)
        fs.rename(at, self._fs(f"{self.path}/done-{version}")[1])
        return version

    def clean(self) -> None:
        """Remove all versions but the current one, their markers first."""
        now = self.current()
        for prefix in ("staged-", "done-", "v-"):
            for name in self._names(prefix):
                if now is None or not name.endswith(now):
                    fs, at = self._fs(f"{self.path}/{name}")
                    fs.delete(at, True)

    def remove(self) -> None:
        fs, at = self._fs(self.path)
        fs.delete(at, True)
