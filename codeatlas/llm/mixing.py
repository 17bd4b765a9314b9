"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document gets an expected number of copies ``target / source size``; its integral part is
taken outright and the fraction is rounded by the pivotal method, weighted by document size: two
units duel, word mass moves between them at random until one has no fraction left, and the other
goes on with what remains. Expected copies are kept exactly, and the words a source gives differ
from its target by less than one document. Duels run inside blocks of bounded size; each block's
last fractional unit goes to the next level, a tree of ``log_FAN(n)`` levels per source.

Cases: null text has size 0; null sources form a source of their own, ordered last; a source without
words has target 0; repeated rows are folded into one unit (a fraction ``p`` of ``m`` equal rows gives
``floor(m p)`` rows one copy more, the rest is a unit), so no duplicated id makes a block large.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Units that a block of the tree holds on average; copies a document gives at most; longest generated array.
FAN, MOST, RUN = 48, 3, 65536


def word_count(text) -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3, 1, ... by code point, capped at ``most`` times the size.

    Capping and resharing until none is above is water-filling: with sources ordered by cap per weight,
    one is capped iff its cap does not exceed its share of what the earlier ones left.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = by.withColumn("weight", ((F.row_number().over(one) - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size").cast("double") * most
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = w.withColumn("cap", cap).withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    w = w.withColumn("capped", F.col("cap") * F.sum("weight").over(rest) <= F.col("weight") * left)
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(every)
    gone = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    share = F.col("weight") * (F.col("total") - gone) / free
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def _duel(units, seed: int):
    """Fold an array of units by duels: (the unit left, the units decided)."""
    none = F.lit(None)
    start = F.struct(
        none.cast("struct<k:bigint,doc_id:bigint,source:string,size:bigint,n:bigint,base:bigint,extra:bigint,mass:double,p:double>").alias("u"),
        F.array().cast("array<struct<doc_id:bigint,source:string,size:bigint,n:bigint,base:bigint,extra:bigint>>").alias("out"),
    )

    def done(x, plus):
        return F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), x["size"].alias("size"), x["n"].alias("n"), x["base"].alias("base"), (x["extra"] + plus).alias("extra"))

    def with_p(x, p):
        return F.struct(*[x[c].alias(c) for c in ("k", "doc_id", "source", "size", "n", "base", "extra", "mass")], p.alias("p"))

    def step(acc, b):
        a = acc["u"]
        to_b = F.least(a["p"] * a["mass"], (1 - b["p"]) * b["mass"])
        to_a = F.least(b["p"] * b["mass"], (1 - a["p"]) * a["mass"])
        u = uniform(F.lit(seed), a["k"], b["k"], a["doc_id"], b["doc_id"])
        first = u * (to_b + to_a) < to_a
        # the unit whose bound was met becomes exactly 0 or 1; the other keeps the balance
        a_zero = a["p"] * a["mass"] <= (1 - b["p"]) * b["mass"]
        b_zero = b["p"] * b["mass"] <= (1 - a["p"]) * a["mass"]
        gain_b = F.least(F.lit(1.0), b["p"] + to_b / b["mass"])
        lose_a = F.greatest(F.lit(0.0), a["p"] - to_b / a["mass"])
        gain_a = F.least(F.lit(1.0), a["p"] + to_a / a["mass"])
        lose_b = F.greatest(F.lit(0.0), b["p"] - to_a / b["mass"])
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        won = (
            F.when(first & a_zero, F.struct(with_p(b, gain_b).alias("u"), done(a, zero).alias("d")))
            .when(first, F.struct(with_p(a, lose_a).alias("u"), done(b, one).alias("d")))
            .when(b_zero, F.struct(with_p(a, gain_a).alias("u"), done(b, zero).alias("d")))
            .otherwise(F.struct(with_p(b, lose_b).alias("u"), done(a, one).alias("d")))
        )
        met = F.struct(won["u"].alias("u"), F.concat(acc["out"], F.array(won["d"])).alias("out"))
        return F.when(a.isNull(), F.struct(b.alias("u"), acc["out"].alias("out"))).otherwise(met)

    return F.aggregate(units, start, step)


def pivotal_mix(docs: DataFrame, seed: int = 20240, fan: int = FAN, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` is the number of copies (0 to ``most``) times ``size``.
    """
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, most), "mix-targets")
    x = F.col("target") / F.col("source_size")
    units = (
        sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
        .join(targets, sizes["source"].eqNullSafe(targets["source"]))
        .select("doc_id", sizes["source"].alias("source"), "size", "n", F.when(F.col("size") > 0, x).otherwise(0.0).alias("x"))
        .withColumn("base", F.least(F.floor("x"), F.lit(most)).cast("long"))
        .withColumn("rows", F.col("n") * (F.col("x") - F.col("base")))
        .withColumn("extra", F.floor("rows").cast("long"))
        .withColumn("p", F.col("rows") - F.col("extra"))
        .withColumn("k", F.xxhash64(F.lit(seed), "doc_id", "source", "size"))
        .select("k", "doc_id", "source", "size", "n", "base", "extra", F.col("size").cast("double").alias("mass"), "p")
    )
    whole = F.col("p") <= 1e-12
    blocks = max(1, sizes.count() // fan)
    level = units.where(~whole).withColumn("b", F.pmod("k", F.lit(blocks)).cast("long"))
    flat = ["doc_id", "source", "size", "n", "base", "extra"]
    decided = units.where(whole).select(*flat)
    i = 0
    while True:
        unit = F.struct("k", "doc_id", "source", "size", "n", "base", "extra", "mass", "p")
        folded = level.groupBy("source", "b").agg(F.array_sort(F.collect_list(unit)).alias("units"))
        folded = materialize(folded.select("b", _duel(F.col("units"), seed + i).alias("r")), f"mix-level{i}")
        decided = decided.unionByName(folded.select(F.explode("r.out").alias("d")).select("d.*"))
        if blocks == 1:
            last = folded.select("r.u.*").withColumn("extra", F.col("extra") + (uniform(F.lit(seed - 1), F.col("k")) < F.col("p")).cast("long"))
            decided = decided.unionByName(last.select(*flat))
            break
        level = folded.select("r.u.*", F.floor(F.col("b") / fan).cast("long").alias("b"))
        blocks = -(-blocks // fan)
        i += 1
    runs = decided.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + RUN, F.col("n")) - 1)))
    copies = F.col("base") + (F.col("i") < F.col("extra")).cast("long")
    out = each.select("doc_id", "source", "size", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "i")
    t = targets.withColumnRenamed("source", "t_source")
    return out.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")


def mix_documents(docs: DataFrame, seed: int = 20240) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (rows without words are taken once)."""
    key = [F.col("doc_id").cast("long").alias("__ca_id"), F.col("source").cast("string").alias("__ca_src"), word_count(F.col("text")).alias("__ca_size")]
    columns = docs.columns
    keyed = docs.select("*", *key)
    nth = Window.partitionBy("__ca_id", "__ca_src", "__ca_size").orderBy(F.xxhash64("text"), *[F.col(c) for c in columns if c in ("lang", "n_chars")])
    keyed = keyed.withColumn("__ca_i", F.row_number().over(nth) - 1)
    mix = pivotal_mix(docs, seed).select(F.col("doc_id").alias("__ca_m_id"), F.col("source").alias("__ca_m_src"), F.col("size").alias("__ca_m_size"), F.col("i").alias("__ca_m_i"), F.col("copies").alias("__ca_copies"))
    on = keyed["__ca_id"].eqNullSafe(mix["__ca_m_id"]) & keyed["__ca_src"].eqNullSafe(mix["__ca_m_src"]) & (keyed["__ca_size"] == mix["__ca_m_size"]) & (keyed["__ca_i"] == mix["__ca_m_i"])
    n = F.when(F.col("__ca_size") == 0, 1).otherwise(F.col("__ca_copies")).cast("int")
    return keyed.join(mix, on).withColumn("__ca_c", F.explode(F.array_repeat(F.lit(0), n))).select(*columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
