"""Helpers shared by the training-data operators.

* ``materialize`` cuts lineage with a Parquet table in the folder that ``spark.checkpoint.dir`` names, so a
  lost executor costs a re-read and nothing more; ``discard`` deletes such a table once nothing reads it.
* ``spread`` joins on keys that may hold any share of the rows.
* ``byte_chunks`` slices Arrow batches so numpy temporaries stay bounded whatever the
  length of the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Bytes of text that one vectorised step handles (a longer document forms a step alone).
CHUNK_BYTES = 1 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeatlas/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._table_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a part of a split key; keys that are split at most, since each has one row in so many at least.
SPLIT_ROWS, SPLIT_KEYS = 1 << 16, 4096


def spread(left: DataFrame, right: DataFrame, keys: list[str], count: str, salt: list[str], rows: int = SPLIT_ROWS, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, keys with very many rows of ``left`` dealt to several tasks.

    ``count`` is the column of ``right`` that tells how many rows of ``left`` a key has (the same in all rows of a
    key); ``salt`` are the columns of ``left`` that tell its rows apart. Nothing is split where no key is that large.
    """
    spark = left.sparkSession
    sizes = right.groupBy(*keys).agg(F.first(count).alias("__ca_rows"))
    total = sizes.agg(F.sum("__ca_rows")).first()[0] or 0
    most = max(rows, -(-total // SPLIT_KEYS))
    found = sizes.where(F.col("__ca_rows") > most).toLocalIterator()  # SPLIT_KEYS rows at most
    parts = [(*r[: len(keys)], -(-r["__ca_rows"] // rows)) for r in found]
    if not parts:
        return left.join(right, keys, how)
    hot = F.broadcast(spark.createDataFrame(parts, ", ".join(f"{k} long" for k in keys) + ", __ca_parts long"))
    n = F.coalesce("__ca_parts", F.lit(1).cast("long"))
    left = left.join(hot, keys, "left").withColumn("__ca_salt", F.pmod(F.xxhash64(*salt), n)).drop("__ca_parts")
    right = right.join(hot, keys, "left").withColumn("__ca_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("__ca_parts")
    return left.join(right, [*keys, "__ca_salt"], how).drop("__ca_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty strings."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a null-free large_string array; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return np.zeros(1, np.int64), raw[:0]
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def byte_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive slices of ``batch`` of at most ``limit`` text bytes (one row at least), with their null-free texts."""
    column = utf8(batch.column(batch.schema.get_field_index(text)))
    ends = buffers(column)[0]
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), column.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply), vectorised."""
    x = np.asarray(x).astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def uniform(*columns) -> "F.Column":
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)).cast("double") / float(1 << 53)


#: Bits of a key filter: its size is this at most (128 MB), whatever the input.
FILTER_BITS = 1 << 30
_PART_BITS = 1 << 20


def key_filter(keys: DataFrame, most_bits: int = FILTER_BITS) -> bytes:
    """A bitmap that every key (a long, the only column) passes, and others rarely while it isn't overfull.

    It spares the shuffle of rows that a later join drops anyway; an overfull one only lets more through.
    """
    n = keys.count()
    bits = min(most_bits, max(1 << 12, 1 << (32 * n).bit_length()))
    part = min(_PART_BITS, bits)
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits))
    rows = keys.select(F.floor(at / part).cast("long").alias("part"), (at % part).cast("int").alias("at"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            parts, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(parts).tolist():
                held.setdefault(p, np.zeros(part, bool))[at[parts == p]] = True
        for p, marks in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["part", "marks"])

    out = bytearray(bits // 8)
    for r in rows.repartition("part").mapInArrow(fold, "part long, marks binary").coalesce(16).toLocalIterator():  # ``bits`` in all; a job for each partition
        out[r["part"] * (part // 8) : (r["part"] + 1) * (part // 8)] = r["marks"]
    return bytes(out)


def passes(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which xxhash64 values of keys pass a filter."""
    at = hashes % np.int64(len(marks) * 8)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


# -- words of UTF-8 texts, vectorised -------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
#: [\x20\x09-\x0D] separate words; no byte of a longer UTF-8 sequence is among them.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, m in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, m, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lower-cased: (start, end, hash, first word of each text, bytes)."""
    low = _LOWER[raw]
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64), low
    solid = ~_SPACE[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:n]
    stop[:-1] &= ~solid[1:] | cut[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, span_hashes(low, start, end), np.searchsorted(start, offsets), low
