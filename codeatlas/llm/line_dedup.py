"""Line dedup over pieces of two or more lines.

The query and the pipeline take every two consecutive lines as a piece (``pairs``). Pieces overlap, so a
passage of two or more whole lines that occurs earlier is covered by repeated pieces from its first line to
its last, whatever stands around it, and goes whole. ``chunks``, the default, are disjoint pieces: a rolling
hash over the hashes of two consecutive lines chooses where they end, so they are fewer, but of a short
passage they may find a part or nothing.

A piece that occurs elsewhere is removed, except where it occurs first (smallest doc_id, then position).
Digests of 128 bits propose the repeats and pre-aggregate to one row a digest; then the bytes of every
proposed piece are compared, and a digest whose pieces differ removes nothing. Only digests and ids are
shuffled to find repeats; the texts move once, to meet the decisions about them, and repeated pieces once
more, to be compared. The places of a digest that very many documents hold are dealt to several tasks.

Cases: null and empty texts have no piece and stay as they are; rows that share a doc_id count as one
occurrence (each keeps its first copies); null ids count as the smallest id; a repeat inside one document
is removed too, unless it shares a line with its first place; blank lines are lines; single lines and
passages that begin or end inside a line are never removed as such; the first place of a piece may lose a
line to an earlier piece, but each line stays at its own first place; extra columns stay; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, byte_chunks, materialize, mix64, span_hashes, spread, table

#: One line in so many ends a chunk, of at least LEAST and at most MOST lines.
EVERY, LEAST, MOST = 2, 2, 16
_NULL = -(2**63)
Pieces = Callable[[pa.Array], list[list[tuple[int, int, int]]]]


def _lines(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end without the newline, text, place in it) of all lines, and each text's first line and count."""
    breaks = np.flatnonzero(raw == 10)
    count = np.diff(np.searchsorted(breaks, offsets)) + 1  # lines of each text
    first = np.cumsum(count) - count
    lines_of = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(lines_of)) - first[lines_of]
    start, end = np.empty(len(lines_of), np.int64), np.empty(len(lines_of), np.int64)
    last = np.append(pos[1:] == 0, True)
    start[pos == 0], start[pos > 0] = offsets[:-1], breaks + 1
    end[last], end[~last] = offsets[1:], breaks
    return start, end, lines_of, pos, first, count


def pairs(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Like ``chunks`` for every two consecutive lines; a text of one line is its only piece."""
    offsets, raw = buffers(texts)
    start, end, lines_of, _, first, count = _lines(offsets, raw)
    start, end = (start - offsets[lines_of]).tolist(), (end - offsets[lines_of]).tolist()
    return [[(start[i], end[i + 1], 2) for i in range(f, f + n - 1)] or [(start[f], end[f], 1)] for f, n in zip(first.tolist(), count.tolist(), strict=True)]


def chunks(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """(start byte, end byte without the last newline, lines) of the chunks of each text, in order."""
    offsets, raw = buffers(texts)
    start, end, lines_of, pos, first, count = _lines(offsets, raw)
    h = span_hashes(raw, start, end)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    before[pos == 0] = 0
    stop = mix64(h + before * np.uint64(0xD1B54A32D192ED03)) % np.uint64(EVERY) == 0
    out: list[list[tuple[int, int, int]]] = []
    stop, start, end = stop.tolist(), (start - offsets[lines_of]).tolist(), (end - offsets[lines_of]).tolist()
    for f, n in zip(first.tolist(), count.tolist(), strict=True):
        own, at = [], f
        for i in range(f, f + n):
            if i == f + n - 1 or i - at + 1 >= MOST or stop[i] and i - at + 1 >= LEAST:
                own.append((start[at], end[i], i - at + 1))
                at = i + 1
        out.append(own)
    return out


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__ca_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)))


def _occurrences(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(h1, h2, k): the digests of the multi-line pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text"):
                out = []
                for k, text, own in zip(rows.column(0).to_pylist(), texts.to_pylist(), pieces(texts), strict=True):
                    b = text.encode()
                    out += [(*d, k) for d in {_digest(b[s:e]) for s, e, n in own if n >= LEAST}]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["h1", "h2", "k"])

    return docs.select("__ca_k", F.col("text").cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, k long")


def marked(docs: DataFrame, pieces: Pieces = chunks) -> DataFrame:
    """``docs`` with ``__ca_k`` and ``__ca_repeats``: (h1, h2, first k) of its pieces that other documents have too."""
    keyed = _keyed(docs)
    seen = materialize(_occurrences(keyed, pieces), "pieces")
    repeated = seen.groupBy("h1", "h2").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("first") < F.col("last")).drop("last")
    hits = spread(seen, materialize(repeated, "repeated"), ["h1", "h2"], "n", ["k"]).drop("n")
    by = hits.groupBy(F.col("k").alias("__ca_m")).agg(F.collect_list(F.struct("h1", "h2", "first")).alias("__ca_repeats"))
    met = materialize(keyed.join(by, F.col("__ca_k") == F.col("__ca_m"), "left").drop("__ca_m"), "marked")
    unlike = materialize(_unlike(met, pieces), "unlike")
    if not unlike.isEmpty():  # texts that share 128 bits of digest: such pieces stay
        hits = hits.join(unlike, ["h1", "h2"], "left_anti")
        by = hits.groupBy(F.col("k").alias("__ca_m")).agg(F.collect_list(F.struct("h1", "h2", "first")).alias("__ca_repeats"))
        met = met.drop("__ca_repeats").join(by, F.col("__ca_k") == F.col("__ca_m"), "left").drop("__ca_m")
    return met


def _unlike(met: DataFrame, pieces: Pieces) -> DataFrame:
    """Digests whose pieces are not equal byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text"):
                out = []
                for text, own, repeats in zip(texts.to_pylist(), pieces(texts), rows.column(1).to_pylist(), strict=True):
                    b, wanted = text.encode(), {(r["h1"], r["h2"]) for r in repeats}
                    out += [(*d, b[s:e]) for s, e, n in own if n >= LEAST and (d := _digest(b[s:e])) in wanted]
                types = [pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), types, strict=True)], names=["h1", "h2", "b"])

    both = met.where(F.col("__ca_repeats").isNotNull()).select(F.col("text").cast("string").alias("text"), "__ca_repeats").mapInArrow(run, "h1 long, h2 long, b binary")
    return both.groupBy("h1", "h2").agg(F.min("b").alias("x"), F.max("b").alias("y")).where(F.col("x") != F.col("y")).select("h1", "h2")


def _without_chunks(b: bytes, own: list[tuple[int, int, int]], repeat: Callable[[bytes], bool]) -> tuple[list[tuple[int, int]], int, int, int]:
    """(spans that stay, lines, lines removed, chunks removed) of a text of disjoint pieces."""
    met_here: set[bytes] = set()
    kept, gone, spans = [], 0, 0
    for s, e, n in own:
        if n >= LEAST:
            piece = b[s:e]
            if piece in met_here or repeat(piece):
                gone, spans = gone + n, spans + 1
                continue
            met_here.add(piece)
        kept.append((s, e))
    return kept, sum(n for *_, n in own), gone, spans


def _without_pairs(b: bytes, own: list[tuple[int, int, int]], repeat: Callable[[bytes], bool]) -> tuple[list[tuple[int, int]], int, int, int]:
    """(spans that stay, lines, lines removed, runs of lines removed) of a text of overlapping pairs."""
    if own[0][2] < 2:
        return [own[0][:2]], 1, 0, 0
    first_here: dict[bytes, int] = {}
    gone = np.zeros(len(own) + 1, bool)
    for i, (s, e, _) in enumerate(own):
        piece = b[s:e]
        if first_here.setdefault(piece, i) <= i - 2 or repeat(piece):
            gone[i : i + 2] = True
    starts, ends = [s for s, *_ in own], [s - 1 for s, *_ in own[1:]]  # pair i starts with line i
    starts.append(b.rfind(b"\n", 0, own[-1][1]) + 1)
    ends += [starts[-1] - 1, own[-1][1]]
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return [(starts[i], ends[i]) for i in np.flatnonzero(~gone).tolist()], len(gone), int(gone.sum()), runs


def dedup_lines(docs: DataFrame, pieces: Pieces = chunks) -> DataFrame:
    """``docs`` without repeated pieces, with ``__ca_lines``, ``__ca_removed`` (lines) and ``__ca_spans`` (removed chunks, or runs of lines)."""
    met = marked(docs, pieces)
    without = _without_pairs if pieces is pairs else _without_chunks
    columns = [c for c in met.columns if c not in ("__ca_k", "__ca_repeats")]
    schema = docs.select(*columns).schema
    for c in ("__ca_lines", "__ca_removed", "__ca_spans"):
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text"):
                at = {name: i for i, name in enumerate(rows.schema.names)}
                new, counts = [], []
                for given, text, own, k, repeats in zip(rows.column(at["text"]).to_pylist(), texts.to_pylist(), pieces(texts), rows.column(at["__ca_k"]).to_pylist(), rows.column(at["__ca_repeats"]).to_pylist(), strict=True):
                    b, elsewhere = text.encode(), {(r["h1"], r["h2"]): r["first"] for r in repeats or ()}
                    kept, n, gone, spans = without(b, own, lambda piece, k=k, there=elsewhere: bool(there) and there.get(_digest(piece), k) < k)
                    new.append(given if not spans else b"\n".join(b[s:e] for s, e in kept).decode())
                    counts.append((n if given else 0, gone, spans))
                arrays = [pa.array(new, rows.schema.field("text").type) if c == "text" else rows.column(at[c]) for c in columns]
                arrays += [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "__ca_lines", "__ca_removed", "__ca_spans"])

    return met.mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, pieces: Pieces = chunks) -> DataFrame:
    """``docs`` with the same columns; texts lose repeated pieces and n_chars follows."""
    out = dedup_lines(docs, pieces)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__ca_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return dedup_lines(docs, pairs).select("doc_id", F.col("__ca_lines").alias("n_lines"), F.col("__ca_removed").alias("n_removed"), F.col("__ca_spans").alias("n_spans"), F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
