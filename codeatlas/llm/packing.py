"""Best-fit packing of token sequences by bin completion with branch and bound.

A block of pieces is packed as a histogram of lengths. Around the largest piece left, the undominated
fillings of the space beside it are enumerated, least waste first; a filling is used as often as its
lengths allow. The search prunes a branch once its waste exceeds what the best packing so far could
still lose by, starts from a best-fit packing as incumbent, and stops at the volume bound or after
``nodes`` steps. Blocks are independent tasks of bounded size; poorly filled sequences are
repacked together afterwards.

Cases: null and empty texts are the single closing id; repeated rows are packed each; extra columns are
ignored; an empty table gives an empty result; a document of any length is cut only into full pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, materialize, table
from .tokens import WordTokens

SIZE, EOS = 2048, 0
#: Pieces of a block; steps of the search; fillings tried at a step; a sequence filled less is repacked.
BLOCK, NODES, WIDTH, FULL = 50_000, 5_000, 3, 0.98


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- the search -----------------------------------------------------------------------------------


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence, how often)."""
    left, out = counts.copy(), []
    while (largest := _largest(left, size)) > 0:
        have = np.zeros_like(left)
        have[largest], room = 1, size - largest
        left[largest] -= 1
        while room and (x := _largest(left, room)) > 0:
            k = min(int(left[x]), room // x)
            have[x] += k
            left[x] -= k
            room -= k * x
        used = np.flatnonzero(have)
        m = 1 + min([int(left[x] // have[x]) for x in used])
        left[used] -= (m - 1) * have[used]
        out.append((tuple(int(x) for x in reversed(used) for _ in range(int(have[x]))), m))
    return out


def _largest(counts: np.ndarray, most: int) -> int:
    found = np.flatnonzero(counts[1 : most + 1])
    return int(found[-1]) + 1 if len(found) else 0


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` can be put into the items of ``a`` (then ``b`` need not be tried)."""
    if not b:
        return True
    if sum(b) > sum(a):
        return False
    x = b[0]
    return any(x <= y and dominates(a[:i] + ((y - x,) if y > x else ()) + a[i + 1 :], b[1:]) for i, y in enumerate(a))


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Fewest sequences any packing needs: for each k, pieces over size - k stand alone or fit nothing of k or more."""
    n = np.concatenate([[0], np.cumsum(counts)])  # pieces shorter than each length
    v = np.concatenate([[0], np.cumsum(counts * np.arange(size + 1))])
    k = np.arange(0, size // 2 + 1)
    half = size // 2
    alone = n[-1] - n[size - k + 1]
    large = n[size - k + 1] - n[half + 1]
    free = large * size - (v[size - k + 1] - v[half + 1])
    more = v[half + 1] - v[k]
    return int((alone + large + np.maximum(0, -((free - more) // size))).max())


def _sums(sizes: np.ndarray, room: int) -> list[int]:
    """The sums up to ``room`` of one to three of ``sizes``, largest first."""
    every = (1 << (room + 1)) - 1
    one = 0
    for x in sizes.tolist():
        one |= 1 << x
    reach = one
    for _ in range(2):
        more = 0
        for x in sizes.tolist():
            more |= reach << x
        reach |= more & every
    return [i for i in range(room, 0, -1) if reach >> i & 1]


def fillings(counts: np.ndarray, room: int, width: int, lose: int = SIZE) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` that waste at most ``lose``, least waste first, at most ``width``."""
    taken: list[int] = []
    counts = counts[: room + 1]
    sizes = np.flatnonzero(counts)
    # many small items: the largest are taken until three can finish
    if len(sizes) and room > 3 * sizes[-1]:
        counts = counts.copy()
        while len(sizes) and room > 3 * (x := int(sizes[-1])):
            k = min(int(counts[x]), -(-(room - 3 * x) // x))
            taken += [x] * k
            counts[x] -= k
            room -= k * x
            if not counts[x]:
                sizes = sizes[:-1]
        sizes = sizes[sizes <= room]
    if not len(sizes):
        return [tuple(taken)] if room <= lose else []
    there = counts > 0
    out: list[tuple[int, ...]] = []
    for totals in (range(room, max(0, room - 3), -1), None):
        for total in totals or _sums(sizes, room - 3 if room > 3 else 0):
            if room - total > lose:
                return [tuple(taken) + x for x in out]
            for items in _exact(counts, there, sizes, total):
                if not any(dominates(x, items) for x in out):
                    out.append(items)
            if len(out) >= width:
                return [tuple(taken) + x for x in out[:width]]
    return [tuple(taken) + x for x in out]


def _exact(counts: np.ndarray, there: np.ndarray, sizes: np.ndarray, total: int) -> Iterator[tuple[int, ...]]:
    """One, two or three items that add up to ``total``."""
    if total < len(there) and there[total]:
        yield (total,)
        return  # it dominates all others of this sum
    yield from _pairs(counts, there, total, 2)
    below = sizes[sizes <= total - 2]
    for x in below[::-1][:8].tolist():
        for pair in _pairs(counts, there, total - x, 1):
            items = tuple(sorted((x, *pair), reverse=True))
            if all(items.count(y) <= counts[y] for y in items):
                yield items
                return


def _pairs(counts: np.ndarray, there: np.ndarray, total: int, most: int) -> Iterator[tuple[int, ...]]:
    top = min(total - 1, len(there) - 1)
    low = -(-total // 2)
    if top < low:
        return
    big = there[low : top + 1]
    small = there[total - top : total - low + 1][::-1]
    both = np.flatnonzero(big & small)
    for i in both[::-1]:
        x = low + int(i)
        if 2 * x != total or counts[x] > 1:
            yield (x, total - x)
            most -= 1
            if not most:
                return


def pack(lengths: np.ndarray, size: int = SIZE, nodes: int = NODES, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for ``lengths`` (each from 1 to ``size``) as (lengths in it, how often), as few as found."""
    counts = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    total = int((counts * np.arange(size + 1)).sum())
    bound = lower_bound(counts, size)
    best = best_fit(counts, size)
    fewest = sum(m for _, m in best)
    if fewest <= bound:
        return best
    left, path, waste, bins = counts.copy(), [], 0, 0
    stack: list[list] = []  # the fillings not tried yet, and what was taken, of each step
    spent = 0

    def step() -> bool:
        x = _largest(left, size)
        if not x:
            return False
        left[x] -= 1
        options = fillings(left, size - x, width, (fewest - 1) * size - total - waste)
        left[x] += 1
        stack.append([[(x, *o) for o in options][::-1], None])
        return True

    step()
    while stack and spent < nodes:
        frame = stack[-1]
        if frame[1] is not None:
            items, m = frame[1]
            for y in items:
                left[y] += m
            waste -= m * (size - sum(items))
            bins -= m
            path.pop()
            frame[1] = None
        if not frame[0]:
            stack.pop()
            continue
        items = frame[0].pop()
        spent += 1
        m = min(int(left[y]) // items.count(y) for y in set(items))
        lost = size - sum(items)
        # a filling with waste is used once at a time unless nothing better can exist for its largest item
        allowed = (fewest - 1) * size - total
        if waste + m * lost > allowed:
            m = max(0, (allowed - waste) // lost) if lost else m
            if not m:
                continue
        for y in items:
            left[y] -= m
        waste += m * lost
        bins += m
        path.append((items, m))
        frame[1] = (items, m)
        if not step() and bins < fewest:
            best, fewest = list(path), bins
            if fewest <= bound:
                break
    return best


def assign(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece and the fill of each sequence."""
    order = np.argsort(lengths, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(lengths, minlength=size + 1))]).tolist()
    of, place, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for items, m in pack(lengths, size):
        for _ in range(m):
            offset = 0
            for x in items:
                i = order[at[x]]
                at[x] += 1
                of[i], place[i] = len(fill), offset
                offset += x
            fill.append(offset)
    return of, place, np.asarray(fill, np.int64)


# -- the operator ---------------------------------------------------------------------------------

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long, filled long"


def cut(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of at most ``size`` ids of every document."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text"):
                ids, at = tokens.encode(texts)
                own = rows.column(0).to_pylist()
                out: list[tuple] = []
                for i, doc in enumerate(own):
                    x = np.append(ids[at[i] : at[i + 1]], np.uint32(EOS)).astype("<u4")
                    for p, s in enumerate(range(0, len(x), size)):
                        y = x[s : s + size]
                        out.append((doc, p, s, len(y), zlib.crc32(y.tobytes())))
                yield _batch(out, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def pack_pieces(pieces: DataFrame, size: int = SIZE, block: int = BLOCK, full: float = FULL) -> DataFrame:
    """``pieces`` with sequence_id, offset and filled (ids in the sequence)."""

    def packer(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, made, held, rows = (level << 56) | (TaskContext.get().partitionId() << 32), 0, [], 0

            def flush():
                nonlocal made, held, rows
                t = pa.Table.from_batches(held).combine_chunks()
                of, place, fill = assign(t.column("length").to_numpy(), size)
                t = t.append_column("sequence_id", pa.array(base + made + of)).append_column("offset", pa.array(place)).append_column("filled", pa.array(fill[of]))
                made, held, rows = made + len(fill), [], 0
                return t.to_batches()

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    rows += batch.num_rows
                    if rows >= 2 * block:
                        yield from flush()
            if rows:
                yield from flush()

        return run

    n = max(1, -(-pieces.count() // block))
    first = materialize(pieces.repartition(n).mapInArrow(packer(0), PACKED), "packed")
    poor = first.where(F.col("filled") < int(full * size)).select(*[c.split()[0] for c in PIECE.split(", ")])
    m = max(1, -(-poor.count() // block)) if n > 1 else 0
    if not m:
        return first
    return first.where(F.col("filled") >= int(full * size)).unionByName(poor.repartition(m).mapInArrow(packer(1), PACKED))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    return pack_pieces(materialize(cut(docs, tokenizer, size), "pieces"), size).drop("filled")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
