"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's lines are cut into paragraphs of a few words at places that the words themselves choose, so an
edit changes the paragraphs it touches and no others. Their digests go into a table of cells (count, sum
of digests, sum of checks), three cells a digest. Subtracting the cells of two texts leaves the digests
they differ in, and peeling cells that hold a single one recovers them; where peeling gets stuck, a table
four times as large, under other hashes, is tried. All steps run over many documents at once.

Likeness is the Dice coefficient of the two sets of digests, 1 for two texts without words. The printed
fingerprint is the smallest table.

Neighbours by doc_id are found in one shuffle of compressed texts: rows go to ranges of doc_id, and the
first row of each range is also sent to the range before it.

Cases: null texts are empty; rows with equal doc_id are neighbours, ordered by their text; null ids come
first; a single row is its own neighbour; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, mix64, table, words_of

#: Cells of the printed table; growth at a retry; a word in so many begins a paragraph; rows of a range; most ranges.
CELLS, GROW, PARAGRAPH, RANGE, RANGES = 24, 4, 3, 4096, 20_000
_NULL = -(2**63)


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph digests, first of each text), distinct and sorted within each text."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    start, _, key, first, low = words_of(offsets, raw)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    lines = np.concatenate([[0], np.cumsum(low == 10)])[start]
    new = key % np.uint64(PARAGRAPH) == 0
    new[0] = True
    new[1:] |= lines[1:] != lines[:-1]
    new[first[:-1][first[:-1] < n]] = True
    at = np.flatnonzero(new)
    place = (np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))).astype(np.uint64)
    digest = mix64(np.add.reduceat(mix64(key + place * np.uint64(0x9E3779B97F4A7C15)), at))
    of = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((digest, of))
    digest, of = digest[order], of[order]
    keep = np.ones(len(digest), bool)
    keep[1:] = (digest[1:] != digest[:-1]) | (of[1:] != of[:-1])
    digest, of = digest[keep], of[keep]
    return digest, np.searchsorted(of, np.arange(len(texts) + 1))


def _cells(digest: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, one in each third of the table (3 x n)."""
    third, salt = cells // 3, np.uint64(cells)
    return np.stack([(mix64(digest + salt * np.uint64(2 * k + 1)) % np.uint64(third)).astype(np.int64) + k * third for k in range(3)])


def _check(digest: np.ndarray) -> np.ndarray:
    return mix64(digest ^ np.uint64(0xA5A5A5A55A5A5A5A))


class Sketches:
    """Tables of many texts as arrays (text, cell)."""

    def __init__(self, digest: np.ndarray, first: np.ndarray, cells: int):
        n = len(first) - 1
        of = np.repeat(np.arange(n), np.diff(first))
        at = (_cells(digest, cells) + of * cells).ravel()
        self.count = np.bincount(at, minlength=n * cells).reshape(n, cells).astype(np.int64)
        self.key, self.check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
        np.add.at(self.key, at, np.tile(digest, 3))
        np.add.at(self.check, at, np.tile(_check(digest), 3))
        self.key, self.check = self.key.reshape(n, cells), self.check.reshape(n, cells)

    def subtract(self, other: "Sketches") -> "Sketches":
        out = object.__new__(Sketches)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(peeled clean, digests only here, only there, the digests as (pair, side, digest))."""
        n, cells = self.count.shape
        count, key, check = self.count.ravel(), self.key.ravel(), self.check.ravel()
        here, there, found = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        look = np.flatnonzero(np.abs(count) == 1)
        while len(look):
            one = count[look]
            value = np.where(one > 0, key[look], np.uint64(0) - key[look])
            pure = (np.abs(one) == 1) & (_check(value) == np.where(one > 0, check[look], np.uint64(0) - check[look]))
            value, pair, one = value[pure], look[pure] // cells, one[pure]
            if not len(value):
                break
            _, keep = np.unique(np.stack([pair.astype(np.uint64), value]), axis=1, return_index=True) if len(value) > 1 else (None, np.zeros(1, np.int64))
            value, pair, one = value[keep], pair[keep], one[keep]
            found.append((pair, one, value))
            here += np.bincount(pair[one > 0], minlength=n)
            there += np.bincount(pair[one < 0], minlength=n)
            at = _cells(value, cells) + pair * cells
            sign = np.tile(one, 3)
            flat = at.ravel()
            np.subtract.at(count, flat, sign)
            for field, v in ((key, value), (check, _check(value))):
                np.subtract.at(field, flat, np.where(sign > 0, np.tile(v, 3), np.uint64(0) - np.tile(v, 3)))
            look = np.unique(flat)
            look = look[np.abs(count[look]) == 1]
        rest = (self.count != 0) | (self.key != 0) | (self.check != 0)
        parts = tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return ~rest.any(axis=1), here, there, parts

    def printed(self, i: int, size: int) -> str:
        row = self.count[i].astype("<u4").tobytes() + self.key[i].astype("<u8").tobytes() + self.check[i].astype("<u4").tobytes()
        return f"{size}:" + base64.b64encode(row).decode()


def _rows(digest: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)[rows]
    ends = np.cumsum(sizes)
    at = np.repeat(first[:-1][rows] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return digest[at], np.concatenate([[0], ends])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Dice coefficients of pairs of digest sets, found by subtracting and peeling tables."""
    na, nb = np.diff(a[1]), np.diff(b[1])
    out, open_ = np.ones(len(na)), np.flatnonzero(na + nb)
    while len(open_):
        stuck = []
        step = max(1, (1 << 19) // cells)  # bounds the arrays
        for at in range(0, len(open_), step):
            rows = open_[at : at + step]
            clean, here, there, _ = Sketches(*_rows(*a, rows), cells).subtract(Sketches(*_rows(*b, rows), cells)).peel()
            good = rows[clean]
            out[good] = (na[good] + nb[good] - here[clean] - there[clean]) / (na[good] + nb[good])
            stuck.append(rows[~clean])
        open_, cells = np.concatenate(stuck), cells * GROW
    return out


def difference(a: str, b: str, cells: int = CELLS) -> tuple[list[int], list[int]]:
    """The paragraph digests only ``a`` and only ``b`` has."""
    da, fa = digests([a.encode()])
    db, fb = digests([b.encode()])
    while True:
        clean, _, _, (_, side, value) = Sketches(da, fa, cells).subtract(Sketches(db, fb, cells)).peel()
        if clean[0]:
            return sorted(value[side > 0].tolist()), sorted(value[side < 0].tolist())
        cells *= GROW


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """One output row for each (doc_id, text, next text)."""
    texts = [r[1].encode() for r in rows]
    changed = [edited(r[1], r[2]).encode() for r in rows]
    own, new, after = digests(texts), digests(changed), digests([r[2].encode() for r in rows])
    s, t = Sketches(*own, CELLS), Sketches(*new, CELLS)
    ns, nt = np.diff(own[1]), np.diff(new[1])
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
            pa.array([s.printed(i, int(ns[i])) for i in range(len(rows))]),
            pa.array([t.printed(i, int(nt[i])) for i in range(len(rows))]),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, after)),
        ],
        names=names,
    )


def with_next(docs: DataFrame, size: int = RANGE) -> tuple[DataFrame, int]:
    """(bucket, halo, k, doc_id, z): compressed texts by range of doc_id, each with the row that follows it."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("k")
    ids = docs.select(k)
    n = min(RANGES, max(1, ids.count() // size))
    cuts = np.zeros(0, np.int64)
    if n > 1:
        marks = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n).alias("m")).first()["m"] or []
        cuts = np.unique(np.asarray(marks, np.int64))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy()
            at = np.searchsorted(cuts, v, "right")
            kinds = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([v[at == x].min() for x in kinds], pa.int64())], names=["bucket", "k"])

    found = ids.mapInArrow(locate, "bucket long, k long").groupBy("bucket").agg(F.min("k").alias("k")).orderBy("bucket").collect()  # a row for each range
    heads = {r["k"]: found[i - 1]["bucket"] for i, r in enumerate(found)}  # the first row of a range also follows the range before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text"):
                key = rows.column(0).to_numpy()
                bucket = np.searchsorted(cuts, key, "right")
                out = []
                for i, (b, v, d) in enumerate(zip(bucket.tolist(), key.tolist(), rows.column(1).to_pylist(), strict=True)):
                    z = pack.compress(texts[i].as_py().encode())
                    out.append((b, False, v, d, z))
                    if v in heads:
                        out.append((heads[v], True, v, d, z))
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "halo", "k", "doc_id", "z"])

    rows = docs.select(k, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket long, halo boolean, k long, doc_id long, z binary"), max(1, len(found))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    rows, n = with_next(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        un = zstandard.ZstdDecompressor()
        before, held, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, halo, _, doc, z = (batch.column(c)[i].as_py() for c in range(5))
                if halo and (before is None or before[0] != bucket):
                    continue  # a second row with the id that begins the next range
                text = un.decompress(z, max_output_size=1 << 31).decode() if z else ""
                if before is not None and before[0] == bucket:
                    held.append((before[1], before[2], text))
                    size += len(before[2])
                before = None if halo else (bucket, doc, text)
                if size > 1 << 19:
                    yield compare(held)
                    held, size = [], 0
        if held:
            yield compare(held)

    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "halo", "k", "z").mapInArrow(run, SCHEMA)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
