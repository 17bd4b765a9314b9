"""Transitive closures of edge tables, to any depth; cycles end by themselves.

Each round is a table in the folder that ``spark.checkpoint.dir`` names, so plans don't grow and a lost
executor costs a re-read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .joins import first_by

SHORT = 8  # hops up to which all pairs are met in rounds
BLOCK = 2048  # nodes of a chain in one row; a pair of blocks has the square of it in pairs


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): the pairs that edges (src, dst) connect, with the least number of hops.

    Without ``start`` rounds double the reach: the pairs farther than 2^k hops, up to twice that, are those at
    2^k hops met with the nearer ones. Beyond ``SHORT`` hops chains that never branch are numbered instead
    (``lines``), since their pairs grow with the square of their length. From given nodes (src) each round goes one hop, and touches only what
    they reach. Rounds end when nothing new is found.
    """
    edges = edges.select("src", "dst").distinct()
    if start is not None:
        return _from(edges, edges.join(start.select("src").distinct(), "src", "left_semi"))
    found, reach, drawn = [cut(edges.withColumn("depth", F.lit(1)))], 1, None
    while True:
        if reach == SHORT:
            drawn, nodes = lines(found[0].select("src", "dst"))
            found = found if drawn is None else [cut(f.join(nodes, "src", "left_anti")) for f in found]
        all_ = reduce(DataFrame.unionByName, found)
        far = found[-1].where(F.col("depth") == reach).select("src", F.col("dst").alias("mid"))
        more = all_.select(F.col("src").alias("mid"), "dst", (F.col("depth") + reach).alias("depth"))
        new = far.join(more, "mid").groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        new = cut(new.join(all_.select("src", "dst"), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return all_ if drawn is None else all_.unionByName(drawn)
        found.append(new)
        reach *= 2


def lines(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """((src, dst, depth), (src)): the pairs of the chains that are a whole component, and their nodes but the last; or nothing.

    Pointers that double tell each node how far its chain's end is. The pairs themselves are never stored or dealt:
    two blocks of ``BLOCK`` nodes of a chain meet in one task, which streams their pairs.
    """
    spark = edges.sparkSession
    one = lambda c: edges.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(c)
    plain = cut(edges.join(one("src"), "src", "left_semi").join(one("dst"), "dst", "left_semi").select("src", "dst"))
    ends = lambda df: df.join(plain.select(F.col("src").alias("dst"), F.lit(True).alias("on")), "dst", "left").select("src", "dst", "far", F.col("on").isNotNull().alias("on"))
    at, left = cut(ends(plain.withColumn("far", F.lit(1)))), None
    while (n := at.where("on").count()) and n != left:  # on a cycle no end comes nearer
        left = n
        hop = at.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("far").alias("more"), F.col("on").alias("still"))
        open_ = at.where("on").join(hop, "dst").select("src", F.col("next").alias("dst"), (F.col("far") + F.col("more")).alias("far"), F.col("still").alias("on"))
        at = cut(at.where("NOT on").unionByName(open_))
    at = at.where("NOT on").select("src", F.col("dst").alias("chain"), "far")
    size = at.groupBy("chain").agg(F.max("far").alias("size"), F.max_by("src", "far").alias("head"))
    size = size.join(edges.select(F.col("src").alias("chain")), "chain", "left_anti").join(edges.select(F.col("dst").alias("head")), "head", "left_anti")
    at = cut(at.join(size.select("chain", "size"), "chain"))
    if at.isEmpty():
        return None, None
    node = at.select("chain", (F.col("size") - F.col("far")).alias("place"), F.col("src").alias("node"))
    node = node.unionByName(at.where("far = 1").select("chain", F.col("size").alias("place"), F.col("chain").alias("node")))
    block = F.floor(F.col("place") / BLOCK).cast("int")
    blocks = cut(node.groupBy("chain", block.alias("b")).agg(F.collect_list(F.struct("place", "node")).alias("held")))
    many = at.where("far = size").select("chain", F.floor(F.col("size") / BLOCK).cast("int").alias("last"))
    pairs = many.select("chain", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("b")).select("chain", "b", F.explode(F.sequence(F.col("b"), F.col("last"))).alias("c"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, min(10_000, pairs.count() // 8))
    met = pairs.join(blocks.withColumnRenamed("held", "from"), ["chain", "b"]).join(blocks.select("chain", F.col("b").alias("c"), F.col("held").alias("to")), ["chain", "c"])
    met = met.repartition(tasks, "chain", "b", "c").select(F.explode("from").alias("s"), "to").select("s", F.explode("to").alias("t"))
    drawn = met.where("t.place > s.place").select(F.col("s.node").alias("src"), F.col("t.node").alias("dst"), (F.col("t.place") - F.col("s.place")).alias("depth"))
    return drawn, at.select("src")


def _from(edges: DataFrame, first: DataFrame) -> DataFrame:
    level = cut(first.withColumn("depth", F.lit(1)))
    levels, step = [level], edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        seen = reduce(DataFrame.unionByName, levels)
        new = level.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        level = cut(new.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(len(levels) + 1)))
        if level.isEmpty():
            return seen
        levels.append(level)


def terminals(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(src, dst, depth): where chains from ``start`` (src) end; nodes without an edge end at themselves."""
    out = closure(edges, start)
    ends = out.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    alone = start.select("src").distinct().join(edges.select("src").distinct(), "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(0).alias("depth"))
    return ends.select("src", "dst", "depth").unionByName(alone)


def member_lookup(asked: DataFrame, parents: DataFrame, members: DataFrame) -> DataFrame:
    """For (type, name) the member of the type or of the nearest ancestor that has one.

    ``parents``: (src, dst, rank) in lookup order; ``members``: (type, name, member).
    """
    up = closure(parents, asked.select(F.col("type").alias("src")))
    order = parents.groupBy("src").agg(F.min("rank").alias("rank"))
    chain = asked.select(F.col("type").alias("src"), F.col("type").alias("dst"), F.lit(0).alias("depth")).distinct().unionByName(up)
    chain = chain.join(order.withColumnRenamed("src", "dst"), "dst", "left")
    met = asked.join(chain, asked["type"] == chain["src"]).join(members.select(F.col("type").alias("dst"), "name", "member"), ["dst", "name"])
    return first_by(met, ["type", "name"], [F.col("depth"), F.col("rank").asc_nulls_last(), "dst"]).select("type", "name", "member", "depth", F.col("dst").alias("owner"))


def common_ancestor(groups: DataFrame, parents: DataFrame) -> DataFrame:
    """The nearest type that all types of a group (group, type) are or descend from."""
    up = closure(parents, groups.select(F.col("type").alias("src")))
    self_ = groups.select(F.col("type").alias("src"), F.col("type").alias("dst"), F.lit(0).alias("depth")).distinct()
    all_ = groups.select("group", F.col("type").alias("src")).distinct().join(self_.unionByName(up), "src")
    size = groups.groupBy("group").agg(F.count_distinct("type").alias("n"))
    shared = all_.groupBy("group", "dst").agg(F.count_distinct("src").alias("k"), F.sum("depth").alias("far")).join(size, "group").where("k = n")
    return first_by(shared, ["group"], [F.col("far"), "dst"]).select("group", F.col("dst").alias("ancestor"))
