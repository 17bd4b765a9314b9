"""PropertyGraph: node and edge DataFrames, and pattern expansion over them.

Every operator is a pure function of DataFrames; Catalyst plans the joins. No hint is given: sides are
broadcast where Spark knows that they are below its threshold, and hot endpoints are left to AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGE, NODES, RELS, Rel, conform, wide


@dataclass
class PropertyGraph:
    spark: SparkSession
    nodes: dict[str, DataFrame]
    edges: dict[Rel, DataFrame] = field(default_factory=dict)

    # -- scans ------------------------------------------------------------------------------------

    def scan(self, label: str) -> DataFrame:
        """All nodes of a label; a label without a table is an empty one."""
        if label not in NODES:
            raise ValueError(f"invalid_node_type: {label}")
        return self.nodes[label] if label in self.nodes else self.spark.createDataFrame([], NODES[label])

    def rel(self, rel: Rel) -> DataFrame:
        return self.edges[rel] if rel in self.edges else self.spark.createDataFrame([], EDGE)

    def table(self, name: str) -> DataFrame:
        """All pairs of an edge table, with their labels."""
        parts = [self.rel(r).select(F.lit(r.source).alias("from_label"), F.lit(r.target).alias("to_label"), *EDGE.names) for r in RELS if r.table == name]
        return reduce(DataFrame.unionByName, parts)

    def get_by(self, label: str, column: str, values: Sequence) -> DataFrame:
        """Nodes whose column is one of ``values``; long lists become a semi join, none gives none."""
        nodes = self.scan(label)
        if not values:
            return nodes.limit(0)
        if len(values) <= 200:
            return nodes.where(F.col(column).isin(list(values)))
        given = self.spark.createDataFrame([(v,) for v in set(values)], [column]).select(F.col(column).cast(nodes.schema[column].dataType))
        return nodes.join(given, column, "left_semi")

    # -- expansion --------------------------------------------------------------------------------

    def expand(self, rel: Rel, edge: Column | None = None, how: str = "inner", source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
        """(s.*, r.*, t.*) as structs for (s)-[r]->(t); ``edge`` filters r before any join."""
        s = (self.scan(rel.source) if source is None else source)
        t = (self.scan(rel.target) if target is None else target)
        r = self.rel(rel)
        if edge is not None:
            r = r.where(edge)
        s, r, t = (d.select(F.struct(*d.columns).alias(n)) for d, n in ((s, "s"), (r, "r"), (t, "t")))
        return s.join(r, F.col("s.id") == F.col("r.source_id"), how).join(t, F.col("r.target_id") == F.col("t.id"), how)

    def expand_back(self, rel: Rel, edge: Column | None = None) -> DataFrame:
        """(s)<-[r]-(t): s is the node that r points to."""
        return self.expand(rel, edge).select(F.col("t").alias("s"), "r", F.col("s").alias("t"))

    def undirected(self, rel: Rel, edge: Column | None = None) -> DataFrame:
        """(source_id, target_id, type, edge_id, forward): both orientations of every edge."""
        r = self.rel(rel)
        if edge is not None:
            r = r.where(edge)
        there = r.select("source_id", "target_id", "type", "edge_id", F.lit(True).alias("forward"))
        back = r.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "type", "edge_id", F.lit(False).alias("forward"))
        return there.unionByName(back)

    def optional(self, rel: Rel, anchor: str, edge: Column | None = None) -> DataFrame:
        """Every node of the anchor side ("source" or "target") with the edges that satisfy ``edge``, or nulls.

        The edge predicate stands in the join condition, so nodes without such an edge stay.
        """
        label, key = (rel.source, "source_id") if anchor == "source" else (rel.target, "target_id")
        r = self.rel(rel)
        if edge is not None:
            r = r.where(edge)
        n = self.scan(label)
        n, r = n.select(F.struct(*n.columns).alias("n")), r.select(F.struct(*r.columns).alias("r"))
        return n.join(r, F.col("n.id") == F.col(f"r.{key}"), "left")

    def sections(self, rels: Iterable[Rel], limit: int | None = None, node_id: int | None = None, label: str | None = None, order: Sequence[str] = ("source_id", "target_id", "relationship_id"), once: bool = True) -> DataFrame:
        """The wide form of undirected expansions, one section a pair: 17 + 17 + 4 columns, distinct.

        Without ``once`` equal rows stay, for callers that take nodes or counts once themselves: then Spark reads and
        deals the columns they name, not all 38.

        ``limit`` applies to each section's edges under a total order, before their nodes are fetched (edges have
        both nodes); ``node_id`` with ``label`` keeps the edges at one node.
        """
        out = []
        for i, rel in enumerate(rels):
            both = self.undirected(rel).where("forward")
            if node_id is not None:
                at = F.lit(False)
                if rel.source == label:
                    at = at | (F.col("source_id") == node_id)
                if rel.target == label:
                    at = at | (F.col("target_id") == node_id)
                both = both.where(at)
            s = self.scan(rel.source).select(*wide(rel.source, "source_"))
            t = self.scan(rel.target).select(*wide(rel.target, "target_"))
            e = both.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"), F.lit(rel.table).alias("relationship_name"), F.col("type").alias("relationship_type"), F.col("edge_id").alias("relationship_id"), F.lit(i).alias("order_priority"))
            if limit is not None:
                e = e.orderBy(*[{"source_id": "_s", "target_id": "_t"}.get(c, c) for c in order]).limit(limit)
            out.append(e.join(s, F.col("_s") == F.col("source_id")).join(t, F.col("_t") == F.col("target_id")).drop("_s", "_t"))
        drawn = reduce(DataFrame.unionByName, out)
        return drawn.distinct() if once else drawn


def load(spark: SparkSession, path: str) -> PropertyGraph:
    """Read a graph that ``save`` wrote; missing files are empty tables."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def there(p: str) -> bool:
        at = hadoop(p)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    nodes = {n: spark.read.schema(s).parquet(p) for n, s in NODES.items() if there(p := f"{path}/{n.lower()}.parquet")}
    edges = {r: spark.read.schema(EDGE).parquet(p) for r in RELS if there(p := f"{path}/{r.file}")}
    return PropertyGraph(spark, nodes, edges)


def save(graph: PropertyGraph, path: str) -> list[str]:
    """Write one Parquet table a label and a pair under ``path``; empty ones are left out. Returns what was written.

    Each table is planned once and the tables are written side by side, a few at a time.
    """
    spark = graph.spark

    def write(item: tuple) -> str | None:
        name, df, schema = item
        conform(df, schema).write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/{name}")
        if not spark.read.schema(schema).parquet(f"{path}/{name}").isEmpty():
            return name
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return None

    tables = [*((f"{n.lower()}.parquet", d, NODES[n]) for n, d in graph.nodes.items()), *((r.file, d, EDGE) for r, d in graph.edges.items())]
    with ThreadPoolExecutor(4) as side:
        return [name for name in side.map(write, tables) if name]


def register(graph: PropertyGraph) -> list[str]:
    """Temporary views of all labels and edge tables, for SQL with named parameters."""
    names = []
    for label in NODES:
        graph.scan(label).createOrReplaceTempView(label)
        names.append(label)
    for name in dict.fromkeys(r.table for r in RELS):
        graph.table(name).createOrReplaceTempView(name)
        names.append(name)
    return names


def has_table(spark: SparkSession, name: str) -> bool:
    return name.lower() in {t.name.lower() for t in spark.catalog.listTables()}


def query(spark: SparkSession, text: str, **params) -> DataFrame:
    """Raw SQL over the registered views; lists may be passed as parameters."""
    return spark.sql(text, args=params)
