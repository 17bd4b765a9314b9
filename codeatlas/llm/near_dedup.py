"""Near-duplicate classes: banded MinHash candidates, odd sketches, and links confirmed on full sets.

Every text becomes its set of distinct shingles. Texts with equal sets form one class and go on as its
least doc_id. A class's MinHash samples give band keys, and fold into a parity bitmap (odd sketch): the
population count of two bitmaps' XOR estimates how many samples differ, most precisely where few do.

Classes that share a band key are candidates. Inside a band the first open class leads: classes that the
sketch puts above the threshold join it, one pair each, and these pairs are confirmed by intersecting full
shingle sets. Keys with many classes are split into parts; the parts' leaders meet once more, in pairs of parts. Components of
the confirmed links then tell which bands still hold classes of several components. There the sketches find
the classes that come within reach of one of another component; these meet again with their full sets, and
a union-find over exact intersections links what the first round left apart. Pairs are computed in blocks of
bounded size but only links are rows, so a group's size never squares. Nothing is capped, but links are lost
with small probability: those that share no band, and those that the sketch puts out of reach (see ``REACH``).

Cases: texts without words (null, empty) have an empty set, link with nothing and are kept; fewer words
than a shingle form one shingle; rows that share a doc_id are linked; a null doc_id is its own class
and has a null component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, byte_chunks, discard, key_filter, materialize, mix64, passes, spread, table, words_of
from .components import components

#: Words of a shingle and the link threshold of the contract's query (percent); general defaults stand in ``near_classes``.
OP_WORDS, OP_PERCENT = 4, 80
#: Bands and samples in each; bits of an odd sketch; classes of a part of a band.
BANDS, ROWS, BITS, PART = 32, 4, 256, 1024
#: Estimates from percent/100 - REACH up are confirmed on full sets where they may join two components. Of links at
#: 0.80 the sketch so rejects 1.8e-8, less than the 4.7e-8 that share no band (both exact, for random hashes).
REACH = 0.32
_NULL = -(2**63)
_SALT = np.random.default_rng(3).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_A = np.random.default_rng(5).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(6).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, first of each text), sorted within each text."""
    _, _, key, first, _ = words_of(*buffers(texts))
    n = np.diff(first)
    docs = len(n)
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    rolled = np.zeros(len(key), np.uint64)
    for j in range(min(words, len(key))):
        rolled[: len(key) - j] += key[j:] * _SALT[j]
    long = n >= words
    count = np.where(long, n - words + 1, (n > 0).astype(np.int64))
    of = np.repeat(np.arange(docs), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][of]
    value = mix64(rolled[at] + np.uint64(words))
    for d in np.flatnonzero((n > 0) & ~long):  # the whole sequence is its only shingle
        value[np.searchsorted(of, d)] = mix64(np.array([(key[first[d] : first[d + 1]] * _SALT[: n[d]]).sum() + np.uint64(int(n[d]))], np.uint64))[0]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[keep], of[keep]
    return value, np.searchsorted(of, np.arange(docs + 1))


def minhashes(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples (text x sample, uint32) of non-empty sets; empty sets get zeros."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), len(_A)), np.uint32)
    x = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
    step = 1 << 14
    at = 0
    while at < len(some):  # blocks of texts with about ``step`` shingles; a larger text alone, in slices
        to = max(at + 1, int(np.searchsorted(first[some], first[some[at]] + step)))
        rows = some[at:to]
        a, b = first[rows[0]], first[rows[-1] + 1]
        if to - at == 1:
            least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
            for s in range(a, b, step):
                np.minimum(least, _permuted(x[s : min(b, s + step)]).min(axis=0), out=least)
            out[rows[0]] = least
        else:
            out[rows] = np.minimum.reduceat(_permuted(x[a:b]), first[rows] - a, axis=0)
        at = to
    return out


def _permuted(x: np.ndarray) -> np.ndarray:
    y = x[:, None] * _A + _B
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    y ^= y >> np.uint32(12)
    return y


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (text x BITS / 64 words) of the samples."""
    place = mix64(samples.astype(np.uint64) + (np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    flat = (place.astype(np.int64) + np.arange(len(samples))[:, None] * BITS).ravel()
    odd = (np.bincount(flat, minlength=len(samples) * BITS).reshape(len(samples), BITS) & 1).astype(np.uint8)
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities that odd sketches estimate: (rows of one) x (rows of many)."""
    apart = np.bitwise_count(one[:, None, :] ^ many[None, :, :]).sum(axis=2)
    return _SIMILAR[apart]


_p = np.minimum(np.arange(BITS + 1) / BITS, 0.4999)
#: E[odd bits] = BITS/2 * (1 - (1 - 2/BITS)^d) for d differing sample positions, which number 2 * samples * (1 - J).
_SIMILAR = 1 - np.log1p(-2 * _p) / np.log1p(-2 / BITS) / (2 * BANDS * ROWS)


def band_keys(samples: np.ndarray) -> np.ndarray:
    part = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    key = np.zeros(part.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key.view(np.int64)


SKETCHED = "k long, n long, s1 long, s2 long, odd binary, bands array<long>"


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(k, n, s1, s2, odd, bands): set size, set digest, odd sketch and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text", 512 << 10):
                value, first = shingle_sets(texts, words)
                n = np.diff(first)
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value ^ np.uint64(s)))]) for s in (0x1234567, 0x7654321F)]
                s1, s2 = ((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total)
                samples = minhashes(value, first)
                odd, bands = odd_sketches(samples), band_keys(samples)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), pa.array([o.tobytes() for o in odd], pa.binary()), pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, pa.array(bands.ravel()))],
                    names=[c.split()[0] for c in SKETCHED.split(", ")],
                )

    return docs.mapInArrow(run, SKETCHED)


PAIR = "key long, a long, b long, odd binary"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Runs of rows that agree in the first ``keys`` columns (of long type), with the other columns, in order."""
    held, of = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cut = np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            head = tuple(heads[:, s].tolist())
            if head != of:
                if held:
                    yield of, held
                held, of = [], head
            held.append(batch.slice(s, e - s))
    if held:
        yield of, held


def _columns(held: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    t = pa.Table.from_batches(held)
    out = []
    for name in names:
        c = t.column(name)
        out.append(np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), BITS // 64) if name == "odd" else c.to_numpy())
    return out


def _lead(sure: float, pass_on: bool):
    """Leaders of each part of a band: (leader, member) pairs, and (``pass_on``) the leaders of split bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (key, _, parts), held in _groups(batches, 3):
            ids, odd = _columns(held, "k", "odd")
            open_ = np.arange(len(ids))
            while len(open_):
                lead, rest = open_[0], open_[1:]
                if pass_on and parts > 1:
                    out.append((key, int(ids[lead]), None, odd[lead].tobytes()))
                near = estimates(odd[lead : lead + 1], odd[rest])[0] >= sure
                out += [(key, int(ids[lead]), x, None) for x in ids[rest[near]].tolist()]
                open_ = rest[~near]
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return run


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["key", "a", "b", "odd"])


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, parts, k, ...) of a band dealt to pairs of blocks (i, j), so that any two classes meet in one."""
    own = F.pmod(F.xxhash64("k"), F.col("parts")).cast("long")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "parts")


def _apart(rows: DataFrame) -> DataFrame:
    """Rows (key, k, root, ...) of bands with several components, dealt to blocks (i, j) where classes of different ones meet.

    The largest component of a band need not meet itself: its classes go once to each part of the others, so a
    large group with a few strangers beside it costs about its own size.
    """
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    by = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all")).where(F.col("all") > F.col("most.c"))
    parts = lambda n: F.ceil(n / PART).cast("long")
    by = by.select("key", F.col("most.root").alias("main"), parts(F.col("most.c")).alias("pm"), parts(F.col("all") - F.col("most.c")).alias("pn"))
    dealt = rows.join(by, "key").withColumn("h", F.xxhash64("k"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = F.pmod("h", F.col("pn")).cast("long")
    among = F.transform(upto(F.col("pn")), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    across = F.transform(upto(F.col("pm")), lambda p: F.struct((F.col("pn") + p).alias("i"), own.alias("j")))
    main = F.transform(upto(F.col("pn")), lambda x: F.struct((F.col("pn") + F.pmod("h", F.col("pm"))).cast("long").alias("i"), x.alias("j")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))  # a band of two parts at most
    place = F.when((F.col("pm") == 1) & (F.col("pn") == 1), whole).when(F.col("root") == F.col("main"), main).otherwise(F.concat(among, across))
    return dealt.withColumn("at", F.explode(place)).select(*rows.columns, "at.i", "at.j")


def _met(rows: DataFrame, *columns: str) -> DataFrame:
    """Blocks (key, i, j) as runs of rows, each in one task."""
    return rows.select("key", "i", "j", "k", *columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "k")


def _suspects(reach: float):
    """The classes of a band that come within reach of a class of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), held in _groups(batches, 3):
            ids, root, odd = _columns(held, "k", "root", "odd")
            near = np.zeros(len(ids), bool)
            step = max(1, (1 << 18) // len(ids))
            for s in range(0, len(ids), step):
                hit = (estimates(odd[s : s + step], odd) >= reach) & (root[s : s + step, None] != root[None, :])
                near[s : s + step] |= hit.any(axis=1)
                near |= hit.any(axis=0)
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(near.sum()), key), pa.int64()), pa.array(ids[near])], names=["key", "k"])

    return run


def _linked(percent: int):
    """Links between components: exact intersections of each class with all of other components, until none is left apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _), held in _groups(batches, 3):
            t = pa.Table.from_batches(held)
            ids, root = t.column("k").to_numpy(), t.column("root").to_numpy()
            sets = t.column("s").combine_chunks()
            size = np.diff(sets.offsets.to_numpy())
            first = np.cumsum(size) - size
            _, value = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            comp = np.unique(root, return_inverse=True)[1]
            mark = np.zeros(int(value.max(initial=-1)) + 1, np.int32)
            out = []
            for x in np.argsort(-size, kind="stable"):
                far = np.flatnonzero(comp != comp[x])
                if not len(far):
                    continue
                own = value[first[x] : first[x] + size[x]]
                mark[own] = 1
                if len(far) == len(ids) - 1:
                    common = np.add.reduceat(mark[value], first)[far]
                else:
                    n = size[far]
                    ends = np.cumsum(n)
                    at = np.repeat(first[far] - (ends - n), n) + np.arange(int(ends[-1]))
                    common = np.add.reduceat(mark[value[at]], ends - n)
                mark[own] = 0
                good = far[100 * common >= percent * (size[x] + size[far] - common)]
                for y in good.tolist():
                    if comp[y] != comp[x]:
                        out.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
                        comp[comp == comp[y]] = comp[x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(k, s): the full shingle sets of the classes ``ids`` (k). Texts of others stop at a filter and are never shuffled."""
    marks = docs.sparkSession.sparkContext.broadcast(key_filter(ids))  # at most FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column(2).to_numpy())))
            for rows, texts in byte_chunks(batch, "text"):
                value, first = shingle_sets(texts, words)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.LargeListArray.from_arrays(first, pa.array(value.view(np.int64))).cast(pa.list_(pa.int64()))], names=["k", "s"])

    found = docs.select("k", "text", F.xxhash64("k").alias("h")).mapInArrow(run, "k long, s array<long>")
    return materialize(found.join(ids, "k", "left_semi").groupBy("k").agg(F.first("s").alias("s")), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    pairs = materialize(pairs.select("a", "b").where("a != b").distinct(), "pairs")
    sets = _sets(docs, pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct(), words)
    a, b = sets.toDF("a", "x"), sets.toDF("b", "y")
    common = F.size(F.array_intersect("x", "y"))
    out = materialize(pairs.join(a, "a").join(b, "b").where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    discard(pairs, sets)
    return out


def near_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(k, n_shingles, root): the least key that each row's text reaches over links of at least ``percent``."""
    reach = percent / 100 - REACH
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"), F.col("text").cast("string").alias("text"))
    rows = materialize(sketched(docs, words), "sketches")
    some = rows.where((F.col("n") > 0) & (F.col("k") != _NULL))
    classes = materialize(some.groupBy("n", "s1", "s2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("odd").alias("odd"), F.first("bands").alias("bands")), "classes")
    thin = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("k"))
    shared = thin.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    odd = classes.groupBy(F.col("rep").alias("k")).agg(F.first("odd").alias("odd"))
    members = materialize(thin.join(shared, "key").join(odd, "k").select("key", "k", "odd", F.ceil(F.col("c") / PART).cast("long").alias("parts")), "members")
    part = F.pmod(F.xxhash64("k"), F.col("parts")).cast("long").alias("part")
    led = members.select("key", part, "parts", "k", "odd").repartition("key", "part").sortWithinPartitions("key", "part", "k").mapInArrow(_lead(percent / 100, True), PAIR)
    led = materialize(led, "led")
    leaders = led.where(F.col("b").isNull()).select("key", F.col("a").alias("k"), "odd")
    again = leaders.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts"))
    met = _met(_blocks(leaders.join(again, "key")), "odd").mapInArrow(_lead(percent / 100, False), PAIR)
    links = _confirmed(led.where(F.col("b").isNotNull()).unionByName(met), docs, words, percent)
    discard(led)
    roots = materialize(components(links), "roots")
    # bands that hold classes of several components
    labelled = members.join(roots, F.col("k") == F.col("node"), "left").select("key", "k", "odd", F.coalesce("root", "k").alias("root"))
    suspects = materialize(_met(_apart(labelled), "root", "odd").mapInArrow(_suspects(reach), "key long, k long").distinct(), "suspects")
    if not suspects.isEmpty():
        sets = _sets(docs, suspects.select("k").distinct(), words)
        thin = materialize(suspects.join(roots, F.col("k") == F.col("node"), "left").select("key", "k", F.coalesce("root", "k").alias("root")), "suspects")
        more = materialize(_met(_apart(thin).join(sets, "k"), "root", "s").mapInArrow(_linked(percent), "a long, b long").distinct(), "links")
        stars = roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = materialize(components(stars.unionByName(more)), "roots")
        discard(sets, thin, more)
    discard(members, suspects)
    own = classes.join(roots, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", "c", F.coalesce("root", "rep").alias("root"))
    alone = rows.where((F.col("n") == 0) | (F.col("k") == _NULL)).select("k", F.col("n").alias("n_shingles"), F.col("k").alias("root"))
    met = spread(some.select("k", "n", "s1", "s2"), own, ["n", "s1", "s2"], "c", ["k"])
    return alone.unionByName(met.select("k", F.col("n").alias("n_shingles"), "root"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document (the least doc_id) of each group; of rows that share that doc_id one stays."""
    roots = near_classes(docs, words, percent).where(F.col("k") == F.col("root")).select(F.col("k").alias("__ca_root")).distinct()
    keyed = docs.withColumn("__ca_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)))
    return keyed.join(roots, F.col("__ca_k") == F.col("__ca_root"), "left_semi").drop("__ca_k")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"), OP_WORDS, OP_PERCENT)
    back = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return out.select(back("k").alias("doc_id"), "n_shingles", back("root").alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))
