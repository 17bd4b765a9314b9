"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node (the larger ones, or the smaller ones and the node) on the least of them."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = around.join(least, "u")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = hung.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b: long) reaches.

    The loop ends when the edges are stars, after a number of rounds that grows with the logarithm of the nodes
    squared at most; each round's edges are a table in the shared folder.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        before, now = now, materialize(_star(_star(now, True), False), "edges")
        discard(before)
        ends = now.select(F.col("b").alias("x"), F.lit(1).alias("kid"), F.lit(0).alias("head")).unionByName(now.select(F.col("a").alias("x"), F.lit(0).alias("kid"), F.lit(1).alias("head")))
        if ends.groupBy("x").agg(F.sum("kid").alias("kids"), F.max("head").alias("head")).where("kids > 1 OR kids = 1 AND head = 1").isEmpty():
            break  # every node hangs on one that hangs on none
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
