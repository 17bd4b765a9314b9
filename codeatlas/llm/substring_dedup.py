"""Exact substring dedup: bytes covered by a string that also starts in an earlier document.

A first pass finds which least hashes of the ``PIECE``-byte pieces in strings of ``span`` bytes several rows have;
only strings with such a hash go on. They are dealt by the least hash of the shorter ``DEALT``-byte pieces in them,
so equal strings meet wherever they occur; a run of strings with the same least hash is a segment. A segment is
known by its least hash and a hash of its bytes, 128 bits together: a batch of rows sends the bytes of a segment
once, with its least doc_id and how often it occurs. Different segments with one least hash form a shard's text,
whose suffix and common-prefix arrays are built by external induced sorting (``suffix.py``) in bounded memory;
groups of suffixes that share ``span`` bytes get the least doc_id that holds them. A segment whose least hash no
other one has can share no string with another, so it isn't sorted. The places of the segments then meet these
findings: strings that an earlier document holds are marked, and overlapping ones merge into spans. Segments with
very many places are salted there.

Cases: null texts are empty; matches never cross documents; rows that share a doc_id never remove each other's
bytes, and each keeps its own spans, whatever its text; a null doc_id counts as the smallest; extra columns are
ignored; an empty table gives no rows. Rows with equal doc_id and text have equal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LETTER, buffers, byte_chunks, discard, materialize, mix64, powers, spread, table
from .suffix import MEMORY, scratch, suffix_array

#: Bytes of a matching string, of a piece whose hash is filtered and of one whose hash deals to shards; hashes in a bucket of the first pass; a shard closes beyond so many bytes of text (one least hash may bring any number).
SPAN, PIECE, DEALT, BUCKET, SHARD = 50, 24, 16, 1 << 20, 4 << 20
#: Bits of the filter of repeated hashes: its size is this at most (128 MB), whatever the input; an overfull one only lets more through.
FILTER_BITS = 1 << 30
#: Places of a segment beyond which they are dealt to several tasks.
PLACES = 1 << 16
_NULL, _STEP = -(2**63), 1 << 18


def _rows(docs: DataFrame) -> DataFrame:
    """(k, t, text): the ordered id, a hash that tells texts with one id apart, and the text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))


def _totals(raw: np.ndarray) -> np.ndarray:
    """Running sums that give a hash of any span."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * powers(len(raw) + 1)[0][: len(raw)], out=total[1:])
    return total


def _hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((total[end] - total[start]) * powers(len(total))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _least(total: np.ndarray, span: int, piece: int) -> np.ndarray:
    """The least hash of the pieces in the ``span`` bytes from each place on."""
    least = mix64((total[piece:] - total[:-piece]) * powers(len(total))[1][: len(total) - piece])
    wide, k = span - piece + 1, 1
    while 2 * k <= wide:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    return np.minimum(least[: -(wide - k)], least[wide - k :]) if wide > k else least


def _starts(offsets: np.ndarray, span: int) -> np.ndarray:
    """The places where a string of ``span`` bytes inside a text starts."""
    count = np.maximum(0, np.diff(offsets) - span + 1)
    return np.arange(int(count.sum())) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)


def _heads(start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where runs of consecutive strings with one least hash begin.

    A text's last string and the next text's first may be consecutive only if the span is 1.
    """
    return np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)))


# -- the filter of repeated hashes ------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences, byte plane by byte plane."""
    import zstandard

    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _filter(rows: DataFrame, span: int, most_bits: int) -> tuple[bytes, int]:
    """A bitmap of the least hashes that occur in several rows, and its size in bits (a power of two)."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    expected = max(1, 2 * size // (span - PIECE + 2))
    buckets = 1 << max(0, (expected // BUCKET)).bit_length()
    shift = np.uint64(64 - buckets.bit_length() + 1)
    bits = min(most_bits, max(1 << 16, 1 << (2 * expected).bit_length()))
    each = max(8, bits // buckets)  # a bucket's part of the bitmap

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            v = np.concatenate(held)
            held.clear()
            value, count = np.unique(v, return_counts=True)
            v = np.repeat(value, np.minimum(count, 2))
            of = v >> shift if buckets > 1 else np.zeros(len(v), np.uint64)
            cut = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
            made = [(b, _pack(v[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b + 1] > cut[b]]
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], names=["bucket", "v"])

        total = 0
        for batch in batches:
            for _, texts in byte_chunks(batch, "text"):
                offsets, raw = buffers(texts)
                start = _starts(offsets, span)
                if not len(start):
                    continue
                least = _least(_totals(raw), span, PIECE)[start]
                at = _heads(start, least)
                doc, least = np.searchsorted(offsets, start[at], "right") - 1, least[at]
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                own = least[np.append(True, (doc[1:] != doc[:-1]) | (least[1:] != least[:-1]))]
                held.append(mix64(own))  # least hashes crowd near 0; mixed ones fill all buckets alike
                total += len(own)
                if total > 1 << 21:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def close():
            v = np.sort(np.concatenate(held))
            again = np.unique(v[1:][v[1:] == v[:-1]])
            marks = np.zeros(each // 8, np.uint8)
            at = again % np.uint64(each)
            np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([marks.tobytes()], pa.binary())], names=["bucket", "v"])

        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != of and held:
                    yield close()
                    held = []
                of = b
                held.append(_unpack(v))
        if held:
            yield close()

    shape = "bucket long, v binary"
    marks = bytearray(each // 8 * buckets)
    parts = rows.mapInArrow(emit, shape).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(twice, shape)
    made = materialize(parts, "repeated")
    for r in made.toLocalIterator():  # ``bits`` bits in all
        marks[r["bucket"] * (each // 8) : (r["bucket"] + 1) * (each // 8)] = r["v"]
    discard(made)
    return bytes(marks), buckets


# -- segments ---------------------------------------------------------------------------------------


def _repeated(batch: pa.RecordBatch, bits: np.ndarray, buckets: int, span: int):
    """For slices of a batch: (rows, raw bytes, offsets, text, first start, last start, m, h) of the segments that pass the filter."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    each = len(bits) // buckets * 8
    for own, texts in byte_chunks(batch, "text"):
        offsets, raw = buffers(texts)
        start = _starts(offsets, span)
        if not len(start):
            continue
        total = _totals(raw)
        least = _least(total, span, PIECE)[start]
        at = _heads(start, least)
        mixed = mix64(least[at])
        of = (mixed >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(at), np.int64)
        bit = (mixed % np.uint64(each)).astype(np.int64) + of * each
        hit = (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
        start = start[np.repeat(hit, np.diff(np.append(at, len(start))))]
        if not len(start):
            continue
        least = _least(total, span, DEALT)[start]
        at = _heads(start, least)
        first, last = start[at], start[np.append(at[1:], len(start)) - 1]
        yield own, raw, offsets, np.searchsorted(offsets, first, "right") - 1, first, last, least[at].view(np.int64), _hashes(total, first, last + span).view(np.int64)


def _segments(rows: DataFrame, marks, buckets: int, span: int) -> DataFrame:
    """(m, h, first, n, seg): the bytes of a segment once for a batch of rows, with its least k and how often it occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            for own, raw, _, doc, first, last, m, h in _repeated(batch, bits, buckets, span):
                k = own.column(0).to_numpy()[doc]
                order = np.lexsort((h, m))
                new = np.flatnonzero(np.append(True, (m[order][1:] != m[order][:-1]) | (h[order][1:] != h[order][:-1])))
                at = order[new]
                size = last[at] + span - first[at]
                ends = np.cumsum(size)
                data = raw[np.arange(int(ends[-1])) + np.repeat(first[at] - (ends - size), size)]
                seg = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(m[at]), pa.array(h[at]), pa.array(np.minimum.reduceat(k[order], new)), pa.array(np.diff(np.append(new, len(order)))), seg], names=["m", "h", "first", "n", "seg"])

    return rows.mapInArrow(run, "m long, h long, first long, n long, seg binary")


def _places(rows: DataFrame, marks, buckets: int, span: int) -> DataFrame:
    """(m, h, k, t, start): where the segments stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            for own, _, offsets, doc, first, _, m, h in _repeated(batch, bits, buckets, span):
                k, t = (own.column(i).to_numpy()[doc] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m, h, k, t, first - offsets[doc])], names=["m", "h", "k", "t", "start"])

    return rows.mapInArrow(run, "m long, h long, k long, t long, start long")


FOUND = "m long, h long, a long, b long, first long, n long"


def earliest(raw: np.ndarray, ends: np.ndarray, firsts: np.ndarray, span: int, memory: int = MEMORY, stats=None) -> tuple[np.ndarray, ...]:
    """(segment, first start, last start, least k) of the runs of strings by the least k that holds them, as arrays.

    Segments are the bytes ``raw`` up to each of ``ends``; ``firsts`` are their least k.
    """
    lengths = np.diff(ends, prepend=0)
    n = len(raw) + len(ends)
    text, least = scratch(n + 1, np.uint16), scratch(n + 1, np.int64)
    cuts = [0, *(np.searchsorted(ends, np.arange(_STEP, len(raw), _STEP)) + 1).tolist(), len(ends)]  # segments by so many bytes
    cuts = [(s, e) for s, e in zip(cuts, cuts[1:], strict=False) if s < e]
    for s, e in cuts:
        x, y = int(ends[s - 1]) if s else 0, int(ends[e - 1])
        own = np.ones(y - x + e - s, np.uint16)  # a 1 behind each segment
        own[np.arange(y - x) + np.repeat(np.arange(e - s), lengths[s:e])] = raw[x:y].astype(np.uint16) + 2
        text[x + s : y + e] = own
        least[x + s : y + e] = np.repeat(firsts[s:e], lengths[s:e] + 1)
    text[n] = 0
    order, shared = suffix_array(text, span, memory, stats=stats)
    at = 1
    while at <= n:  # batches end where a group of equal strings ends
        to = min(n + 1, at + _STEP)
        while to <= n and shared[to] >= span:
            to += 1
        equal = shared[at:to] >= span
        inside = np.flatnonzero(equal | np.append(equal[1:], False))  # suffixes that share a string
        if len(inside):
            own, heads = order[at:to][inside], np.flatnonzero(~equal[inside])
            value = np.minimum.reduceat(least[own], heads)
            least[own] = np.repeat(value, np.diff(np.append(heads, len(own))))
        at = to
    out: list[list[np.ndarray]] = [[], [], [], []]
    for s, e in cuts:
        count = lengths[s:e] - span + 1
        of = np.repeat(np.arange(s, e), count)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        value = least[(ends - lengths)[of] + of + place]
        new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])))
        last = np.append(new[1:], len(of)) - 1
        for held, x in zip(out, (of[new], place[new], place[last], value[new]), strict=True):
            held.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _sorted(span: int, shard: int):
    """Findings of the shards that a task's rows (m, h, first, n, seg), ordered by m and h, form."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        m, h, first, n = (rows.column(i).to_numpy() for i in range(4))
        heads = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (h[1:] != h[:-1])))  # equal segments are one
        m, h, first, n = m[heads], h[heads], np.minimum.reduceat(first, heads), np.add.reduceat(n, heads)
        segs = rows.column(4).cast(pa.large_binary()).take(pa.array(heads)).combine_chunks()
        # a segment that no other one shares its least hash with holds no string of another: its strings are its own
        met = np.append(False, m[1:] == m[:-1])
        met |= np.append(met[1:], False)
        alone, met = np.flatnonzero(~met), np.flatnonzero(met)
        seg, a, b, least = earliest(*_bytes(segs.take(pa.array(met))), first[met], span)
        ends = np.diff(_bytes(segs)[1], prepend=0)[alone] - span
        seg, a, b, least = (np.concatenate(x) for x in ((met[seg], alone), (a, np.zeros(len(alone), np.int64)), (b, ends), (least, first[alone])))
        useful = (least < first[seg]) | (n[seg] > 1)  # nothing is removed from the only place of a string
        seg, a, b, least = seg[useful], a[useful], b[useful], least[useful]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (m[seg], h[seg], a, b, least, n[seg])], names=[c.split()[0] for c in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            m = batch.column(0).to_numpy()
            at = 0
            while at < len(m):
                to = len(m)
                if size < shard:
                    ends = np.cumsum(np.diff(_bytes(batch.column(4).slice(at).cast(pa.large_binary()))[1], prepend=0))
                    to = at + int(np.searchsorted(ends, shard - size)) + 1
                    to = min(to, len(m))
                    size += int(ends[to - at - 1])
                else:  # equal strings have equal m, so a shard ends between values of m
                    to = int(np.searchsorted(m, last, "right"))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    last = int(m[to - 1])
                if size >= shard and to < len(m) and int(m[to]) != last:
                    yield close(held)
                    held, size = [], 0
                at = to
        if held:
            yield close(held)

    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, end of each value) of a null-free large_binary array."""
    offsets, raw = buffers(column)
    return raw, offsets[1:]


def repeated_spans(docs: DataFrame, span: int = SPAN, shard: int = SHARD, most_bits: int = FILTER_BITS) -> DataFrame:
    """(k, t, a, b): bytes from a to b of a row that strings of earlier documents cover (may overlap)."""
    rows = _rows(docs)
    bits, buckets = _filter(rows, span, most_bits)
    marks = rows.sparkSession.sparkContext.broadcast(bits)  # at most FILTER_BITS
    found = materialize(_segments(rows, marks, buckets, span).repartition("m").sortWithinPartitions("m", "h").mapInArrow(_sorted(span, shard), FOUND), "found")
    places = _places(rows, marks, buckets, span)
    met = spread(places, found, ["m", "h"], "n", ["k", "t", "start"], PLACES)
    return met.where(F.col("first") < F.col("k")).select("k", "t", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + span).alias("b"))


# -- the operator -----------------------------------------------------------------------------------

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"


def merged(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (text, a, b) that overlap or touch as one, in order."""
    if not len(of):
        return of, a, b
    order = np.lexsort((a, of))
    of, a, b = of[order], a[order], b[order]
    wide = int(b.max()) + 2  # keeps texts apart
    reach = np.maximum.accumulate(b + of * wide)
    new = np.flatnonzero(np.append(True, (a + of * wide)[1:] > reach[:-1]))
    return of[new], a[new], reach[np.append(new[1:], len(of)) - 1] - of[new] * wide


def remove_repeated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document: sizes, the digest of the bytes kept, and the removed spans."""
    spans = repeated_spans(docs, span).groupBy("k", "t").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    met = _rows(docs).join(spans, ["k", "t"], "left").select("k", "text", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text"):
                n, (offsets, raw) = len(texts), buffers(texts)
                lists = [rows.column(i).fill_null([]) for i in (2, 3)]
                of = np.repeat(np.arange(n), lists[0].value_lengths().to_numpy())
                of, a, b = merged(of, *(x.flatten().to_numpy() for x in lists))
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, a + offsets[of], 1)
                np.add.at(edge, b + offsets[of], -1)
                stays = np.cumsum(edge[:-1]) == 0
                kept, ends = raw[stays].tobytes(), np.append(0, np.cumsum(stays))[offsets].tolist()
                sizes, count = np.diff(offsets), np.bincount(of, minlength=n)
                where = np.append(0, np.cumsum(count)).astype(np.int32)
                k = rows.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k, mask=k == _NULL), pa.array(sizes), pa.array(sizes - np.diff(ends)), pa.array(count),
                        pa.array([hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)], pa.string()),
                        pa.ListArray.from_arrays(where, pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    return met.mapInArrow(run, RESULT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents")).drop("spans")
