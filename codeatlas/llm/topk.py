"""Exact top-k inner-product search by the threshold algorithm.

Rows are dealt to blocks of bounded size, each row to one block. A task builds the lists of its block once, one
per dimension, sorted by component, and lets the queries pass over them one after another. For a query the lists
are read in step, from the end that its sign prefers; each row met is scored in full (random access), and reading
stops once the bound that the list heads leave for rows not met falls below the k-th score. That score is shared
between blocks: a query first visits one block, and the k-th score it finds there stands against the bounds of all
others. Each block returns at most k rows a query, merged by a window over the queries.

Cases: vectors that are null, or hold a null or a non-finite component, take no part; neither do rows
without a vec_id. Missing trailing components count as 0. Of rows that share a vec_id the one with the
greatest vector stands. Ties go to the smaller vec_id; a query with fewer candidates returns all.
Scores beyond a long are clipped to its range. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of a block; products up to this magnitude are exact as doubles.
ROWS, EXACT = 16384, 2.0**53
_LONG = 2**63 - 1


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * component) of every usable vector, one row a vec_id."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    # floor as a double: exact, and components beyond a long survive
    floors = F.transform("embedding", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return v.groupBy("vec_id").agg(F.max(floors).alias("v"))


class SortedLists:
    """Per-dimension sorted lists over a block of rows (ordered by vec_id)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.up = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32).copy()  # ascending, by dimension
        self.exact = True

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact:  # many rows are scored as one block
            return ((self.rows @ q)[at] if 4 * len(at) > len(self.rows) else self.rows[at] @ q).astype(np.int64)
        whole = [int(c) for c in q]
        return np.array([max(-_LONG - 1, min(_LONG, sum(int(x) * c for x, c in zip(r, whole, strict=True)))) for r in self.rows[at]], dtype=np.int64)

    def top(self, q: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows other than vec_id ``own``; rows below ``least`` may be missing."""
        n, dims = self.rows.shape
        bound = float(np.abs(self.rows).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(dims, 1)
        self.exact = bound < EXACT
        used = np.flatnonzero(q)
        met = np.zeros(n, bool)
        mine = np.searchsorted(self.ids, own)
        mine = int(mine) if mine < n and self.ids[mine] == own else -1
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, 16
        falling = q[used] > 0
        up, down = self.up[used[~falling]], self.up[used[falling]]
        while True:
            if len(used) and depth < n:
                to = min(n, depth + step)
                seen = met.copy()
                seen[up[:, depth:to].ravel()] = True
                seen[down[:, n - to : n - depth].ravel()] = True
            else:
                to, seen = n, np.ones(n, bool)
            new = np.flatnonzero(seen & ~met)
            met = seen
            new = new[new != mine]
            if len(new):
                value = self.scores(new, q)
                if self.exact:  # few rows can be among the best
                    bar = np.partition(value, len(value) - k)[len(value) - k] if len(value) > k else value.min()
                    bar = max(bar, score[-1]) if len(best) >= k else bar
                    good = value >= bar
                    new, value = new[good], value[good]
                best, score = np.concatenate([best, new]), np.concatenate([score, value])
                keep = np.lexsort((best, -score.astype(object) if not self.exact else -score))[:k]
                best, score = best[keep], score[keep]
            if to >= n:
                return best, score
            head = self.rows[np.where(falling, self.up[used, n - to], self.up[used, to - 1]), used] @ q[used]
            bar = score[-1] if len(best) >= k else None
            bar = least if bar is None else bar if least is None else max(bar, least)
            if bar is not None and self.exact and bar > head:  # an equal score with a smaller id may still come
                return best, score
            depth, step = to, min(2 * step, 4096)


SEARCHED = "query_id long, vec_id long, score long"


def _searched(k: int):
    """The k best rows of a block for each query that passes; rows (block, is_query, vec_id, v, least), rows before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, held, lists = None, [], [], None
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])
            out.clear()
            return made

        for batch in batches:
            for block, asks, i, v, least in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if block != of:
                    of, ids, held, lists = block, [], [], None
                if not asks:
                    ids.append(i)
                    held.append(v)
                    continue
                if not ids:
                    continue
                if lists is None:
                    lists = SortedLists(np.asarray(ids, np.int64), _matrix(held, max(map(len, held))))
                    held = []
                dims = lists.rows.shape[1]
                q = np.zeros(dims)
                q[: min(dims, len(v))] = v[:dims]
                at, score = lists.top(q, i, k, least)
                out += zip([i] * len(at), lists.ids[at].tolist(), score.tolist(), strict=True)
                if len(out) > 10_000:
                    yield flush()
        if out:
            yield flush()

    return run


def _matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by ``every``."""
    v = materialize(quantized(vectors), "vectors")
    blocks = max(1, -(-v.count() // rows))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    given = v.select(own.alias("block"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("least"))
    asked = v.where(F.col("vec_id") % every == 0)
    dealt = lambda q: given.unionByName(q).repartition(blocks, "block").sortWithinPartitions("block", "asks", "vec_id").mapInArrow(_searched(k), SEARCHED)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda x: x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = dealt(asked.select(own.alias("block"), F.lit(True).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("least")))
    if blocks > 1:
        home = materialize(home, "home")
        bar = home.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        bar = bar.select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
        others = asked.join(bar, F.col("vec_id") == F.col("query_id"), "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(F.col("block") != own)
        home = home.unionByName(dealt(others.select(F.col("block").cast("int").alias("block"), F.lit(True).alias("asks"), "vec_id", "v", "least")))
    return best(home).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
