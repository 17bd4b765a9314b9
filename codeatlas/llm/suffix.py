"""Suffix and common-prefix arrays by external induced sorting.

The text is cut at its left-most S-type positions; the substrings between them are named by an external bucket
sort, and the string of names is sorted by the same procedure, level below level, until it is short. From the
sorted S*-suffixes the L-suffixes and then the S-suffixes are induced: a priority queue, ordered by character
and then by arrival, holds tuples of a suffix, which move to disk beyond a memory budget and come back in order.

At the text's own level a tuple is (position, common prefix with the entry before it). Entries of a character
arrive in order, so everything of it that is ready is one numpy batch; common prefixes are carried by range
minima over the inducing batch and capped at ``cap``. At the levels of names, whose alphabets are large, a tuple
is (position, name) and a batch is a range of names: suffixes that a batch induces into itself are few and are
merged in by the rank of the suffix that induced them.

Arrays as long as the text are memory-mapped scratch files once they exceed ``HELD`` entries, and every pass over
them goes in batches, so the memory of a process stays bounded however long the text is.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of a queue in memory; entries of an array in memory; names that are sorted directly.
MEMORY, HELD, BASE = 1 << 20, 1 << 23, 1 << 15
#: Entries of a batch; suffixes of a range of names.
_BATCH, _RANGE = 1 << 18, 1 << 17


class Stats:
    """What a sort did: blocks of queue tuples that went to disk, and how many levels of names lay below the text."""

    def __init__(self):
        self.spills, self.depth = 0, 0


class DiskQueue:
    """FIFO blocks of tuples (arrays of equal length) by bucket, on disk beyond ``memory`` bytes.

    A bucket's file goes when the bucket has been read, so the disk holds no more than what is still queued.
    """

    def __init__(self, memory: int = MEMORY, stats: Stats | None = None):
        self.memory, self.held, self.blocks, self.files, self.stats = memory, 0, {}, {}, stats or Stats()

    def push(self, bucket: int, *block: np.ndarray) -> None:
        self.blocks.setdefault(bucket, []).append(block)
        self.held += sum(b.nbytes for b in block)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for bucket, blocks in self.blocks.items():
            for i, b in enumerate(blocks):
                if isinstance(b, tuple):
                    if bucket not in self.files:
                        self.files[bucket] = tempfile.TemporaryFile()  # noqa: SIM115  scratch of this task alone
                    file = self.files[bucket]
                    at = file.seek(0, 2)
                    for x in b:
                        file.write(np.ascontiguousarray(x).data)
                    blocks[i] = [file, at, len(b[0]), [x.dtype for x in b]]
                    self.stats.spills += 1
        self.held = 0

    def pop(self, bucket: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The tuples of ``bucket`` in order, also those that are pushed meanwhile, in batches as large as there are."""
        blocks = self.blocks.get(bucket)
        while blocks:
            yield self._joined(blocks, 0)
        self._drop(bucket)

    def reversed(self, bucket: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The tuples of ``bucket`` in ascending batches, the last batch first."""
        blocks = self.blocks.get(bucket)
        while blocks:
            yield self._joined(blocks, -1)
        self._drop(bucket)

    def _drop(self, bucket: int) -> None:
        self.blocks.pop(bucket, None)
        if bucket in self.files:
            self.files.pop(bucket).close()

    def _joined(self, blocks: list, end: int) -> tuple[np.ndarray, ...]:
        """Blocks from one end of the list, up to a batch, as one."""
        own, n = [], 0
        while n < _BATCH and len(own) < len(blocks) + (len(own) if end else 0):
            own.append(self._load(blocks.pop() if end else blocks[len(own)]))
            n += len(own[-1][0])
        if end:
            own.reverse()
        else:
            del blocks[: len(own)]
        return own[0] if len(own) == 1 else tuple(np.concatenate(c) for c in zip(*own, strict=True))

    def _load(self, b) -> tuple[np.ndarray, ...]:
        if isinstance(b, tuple):
            self.held -= sum(x.nbytes for x in b)
            return b
        file, at, n, kinds = b
        file.seek(at)
        return tuple(np.frombuffer(file.read(n * k.itemsize), k) for k in kinds)

    def close(self) -> None:
        for bucket in list(self.files):
            self._drop(bucket)


def scratch(n: int, kind) -> np.ndarray:
    """An array in memory, or in a scratch file if it is long."""
    if n <= HELD:
        return np.empty(n, kind)
    with tempfile.NamedTemporaryFile() as f:
        return np.memmap(f.name, dtype=kind, mode="w+", shape=(n,))


def batches(n: int, size: int | None = None) -> Iterator[tuple[int, int]]:
    size = size or _BATCH
    return ((s, min(n, s + size)) for s in range(0, n, size))


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last character is a unique smallest one."""
    n = len(text)
    out = scratch(n, bool)
    out[n - 1] = after = True
    for s, e in reversed(list(batches(n - 1))):
        t = np.asarray(text[s : e + 1])
        m = e - s
        at = np.where(t[:-1] != t[1:], np.arange(m), m)  # the next place that differs from its successor
        at = np.minimum.accumulate(at[::-1])[::-1]
        end = at == m
        at[end] = 0
        own = t[at] < t[at + 1]
        own[end] = after
        out[s:e], after = own, bool(own[0])
    return out


def _stars(small: np.ndarray, kind) -> np.ndarray:
    """The S-type positions after an L-type one."""
    found = [np.flatnonzero(small[max(s, 1) : e] & ~small[max(s, 1) - 1 : e - 1]).astype(kind) + kind(max(s, 1)) for s, e in batches(len(small))]
    out, at = scratch(sum(map(len, found)), kind), 0
    for f in found:
        out[at : at + len(f)] = f
        at += len(f)
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Lengths, up to ``cap``, of the common prefixes of suffix pairs."""
    n = len(text)
    out = np.zeros(len(a), np.uint8)
    open_ = np.arange(len(a))
    x, y = a.astype(np.int64), b.astype(np.int64)
    for k in range(cap):
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        open_, x, y = open_[ok], x[ok] + 1, y[ok] + 1
        if not len(open_):
            break
        out[open_] = k + 1
    return out


# -- names of the substrings between S*-positions ---------------------------------------------------


class _Keys:
    """Pieces of S*-substrings, each as many characters as 62 bits hold."""

    def __init__(self, text: np.ndarray, small: np.ndarray, top: int):
        self.text, self.small = text, small
        self.bits = max(1, (top * 2 + 2).bit_length())
        self.per = max(1, 62 // self.bits)

    def __call__(self, star: np.ndarray, length: np.ndarray, done: int) -> np.ndarray:
        key = np.zeros(len(star), np.uint64)
        last = len(self.text) - 1
        for j in range(done, done + self.per):
            p = np.minimum(star.astype(np.int64) + j, last)
            symbol = self.text[p].astype(np.uint64) * np.uint64(2) + self.small[p] + np.uint64(1)
            symbol[j >= length] = 0
            key = (key << np.uint64(self.bits)) | symbol
        return key


def _ranked(keys: _Keys, star: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Dense ranks of substrings, equal ones the same; ``first`` are their first pieces."""
    n = len(star)
    name, open_, key, done = np.zeros(n, np.int64), np.arange(n), first, 0
    while len(open_):
        order = np.argsort(key, kind="stable") if not done else np.lexsort((key, name[open_]))
        k, was = key[order], name[open_][order]
        head = np.append(True, (k[1:] != k[:-1]) | (was[1:] != was[:-1]))
        group = np.append(True, was[1:] != was[:-1])  # a rank leaves room for those that it holds
        place = np.arange(len(order))
        at = np.maximum.accumulate(np.where(head, place, 0))
        name[open_[order]] = was + at - np.maximum.accumulate(np.where(group, place, 0))
        size = np.diff(np.append(np.flatnonzero(head), len(order)))
        done += keys.per
        again = order[np.repeat(size > 1, size)]
        open_ = open_[again]
        open_ = open_[length[open_] > done]
        key = keys(star[open_], length[open_], done)
    used = np.zeros(n, bool)
    used[name] = True
    return (np.cumsum(used) - 1)[name]


def _names(text: np.ndarray, small: np.ndarray, stars: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """(ranks of the substrings from each S*-position to the next, both included, equal ones the same; how many)."""
    n = len(stars)
    keys = _Keys(text, small, top)

    def lengths(s: int, e: int) -> np.ndarray:
        near = np.asarray(stars[s : min(n, e + 1)]).astype(np.int64)
        return np.append(np.diff(near) + 1, 1) if e == n else np.diff(near) + 1

    first = scratch(n, np.uint64)
    for s, e in batches(n):
        first[s:e] = keys(stars[s:e], lengths(s, e), 0)
    if n <= HELD:
        out = _ranked(keys, stars, lengths(0, n), first)
        return out.astype(np.int32), int(out.max()) + 1
    # buckets of first pieces, each sorted alone
    sample = np.sort(first[:: n // (1 << 16) + 1])
    cuts = np.unique(sample[:: max(1, len(sample) * HELD // (8 * n))])
    bucket = lambda s, e: np.searchsorted(cuts, first[s:e], "right")
    count = sum(np.bincount(bucket(s, e), minlength=len(cuts) + 1) for s, e in batches(n))
    ends = np.cumsum(count)
    perm, length, cursor = scratch(n, np.int64), scratch(n, np.int64), (ends - count).tolist()
    for s, e in batches(n):
        b = bucket(s, e)
        length[s:e] = lengths(s, e)
        order = np.argsort(b.astype(np.uint32), kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(b[order]) != 0))
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            k = int(b[order[x]])
            perm[cursor[k] : cursor[k] + y - x] = order[x:y] + s
            cursor[k] += y - x
    out, total = scratch(n, np.int32), 0
    for s, e in zip((ends - count).tolist(), ends.tolist(), strict=True):
        if s == e:
            continue
        parts = list(batches(e - s))
        low, high = min(first[perm[s + x : s + y]].min() for x, y in parts), max(first[perm[s + x : s + y]].max() for x, y in parts)
        if low == high and max(length[perm[s + x : s + y]].max() for x, y in parts) <= keys.per:  # one substring, however often
            for x, y in parts:
                out[perm[s + x : s + y]] = total
            total += 1
            continue
        own = np.asarray(perm[s:e])
        ranks = _ranked(keys, stars[own], length[own], first[own])
        out[own] = ranks + total
        total += int(ranks.max()) + 1
    return out, total


def _doubling(names: np.ndarray) -> np.ndarray:
    """The suffix array of a short string of names by prefix doubling."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while int(rank.max(initial=0)) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        k *= 2
    return order


def _sorted_stars(text: np.ndarray, small: np.ndarray, top: int, memory: int, base: int, stats: Stats, depth: int) -> np.ndarray:
    """The S*-positions in the order of their suffixes, by names and the levels below."""
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    stars = _stars(small, kind)
    names, distinct = _names(text, small, stars, top)
    n = len(stars)
    out = scratch(n, kind)
    if distinct == n:
        for s, e in batches(n):
            out[names[s:e]] = stars[s:e]
        return out
    if n <= base:
        order = _doubling(names)
    else:  # the last star is the end mark, whose name is the only 0
        stats.depth = max(stats.depth, depth + 1)
        order = _sorted_names(names, distinct, memory, base, stats, depth + 1)
    for s, e in batches(n):
        out[s:e] = stars[order[s:e]]
    return out


# -- levels of names --------------------------------------------------------------------------------


def _same_before(names: np.ndarray) -> np.ndarray:
    """How many places directly before each one hold the same name."""
    out, run = scratch(len(names), np.int32), 0
    for s, e in batches(len(names)):
        own = np.asarray(names[s:e])
        at = np.arange(e - s)
        start = np.maximum.accumulate(np.where(np.append(s == 0 or own[0] != names[s - 1], own[1:] != own[:-1]), at, -1))
        out[s:e] = np.where(start >= 0, at - start, at + run)
        run = int(out[e - 1]) + 1
    return out


def _settled(text, small, same, want: bool, first: tuple, last: tuple, low: int, high: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of a range of names in scanning order, which of them are of the wanted type).

    ``first`` (position, name) were queued, in order of arrival; ``last`` stand behind them in each name, in order.
    What they induce into the range itself stands between the two, ordered by the suffix that induced it. Of a run of
    one name only the last place, its root, has another name's suffix as inducer; the others follow by their distance
    from the root, then by the order of the roots.
    """
    pos = np.concatenate([first[0], last[0]]).astype(np.int64)
    name = np.concatenate([first[1], last[1]]).astype(np.int64)
    key = (name - low if sign > 0 else high - 1 - name) * 2
    key[len(first[0]) :] += 1
    order = np.argsort(key.astype(np.uint16) if 2 * (high - low) <= 1 << 16 else key, kind="stable")
    pos, key = pos[order], key[order]
    wanted = (key & 1) == 0
    none = np.zeros(0, np.int64)
    root_pos = root_key = none  # roots that the range induces, and what induced them: a slot, a name, a distance, a root
    by = [none, none, none, none]
    # runs of queued suffixes and of roots, without the roots themselves; the root's number is negative for queued ones
    runs: list[tuple] = []
    at = np.flatnonzero(wanted)
    length = same[pos[at]].astype(np.int64)
    runs.append((pos[at], key[at], at - len(pos), length))
    # the end of each run, from which the next name is induced
    run = np.zeros(len(pos), np.int64)
    run[at] = length
    front = pos - run
    far = np.flatnonzero(run)
    slot, from_key = 2 * np.arange(len(pos)), np.zeros(len(pos), np.int64)
    slot[far], from_key[far] = 2 * np.searchsorted(key, key[far], "right") - 1, key[far]
    front_by = [slot, from_key, run, np.arange(len(pos)) - len(pos)]
    rank = none
    while len(front):
        before = np.maximum(front, 1) - 1
        c = text[before]
        at = np.flatnonzero((c >= low) & (c < high) & (front > 0))
        at = at[small[before[at]] == want]
        if not len(at):
            break
        new, k = before[at], (c[at].astype(np.int64) - low if sign > 0 else high - 1 - c[at].astype(np.int64)) * 2
        number = len(root_pos) + np.arange(len(new))
        root_pos, root_key = np.concatenate([root_pos, new]), np.concatenate([root_key, k])
        by = [np.concatenate([x, y[at]]) for x, y in zip(by, front_by, strict=True)]
        inducer = np.where(by[3] < 0, by[3], np.append(rank, np.zeros(len(new), np.int64))[np.maximum(by[3], 0)])
        order = np.lexsort((inducer, by[2], by[1], by[0], root_key))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        length = same[new].astype(np.int64)
        runs.append((new, k, number, length))
        front, front_by = new - length, [2 * np.searchsorted(key, k, "right") - 1, k, length, number]
    # everything that the range induced into itself: (position, key, distance, root)
    many = [(p[n > 0], k[n > 0], r[n > 0], n[n > 0]) for p, k, r, n in runs]
    step = [np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1 for *_, n in many]
    new_pos = np.concatenate([root_pos, *[np.repeat(p, n) - d for (p, _, _, n), d in zip(many, step, strict=True)]])
    if not len(new_pos):
        return pos, wanted
    new_key = np.concatenate([root_key, *[np.repeat(k, n) for _, k, _, n in many]])
    far = np.concatenate([np.zeros(len(root_pos), np.int64), *step])
    root = np.concatenate([np.arange(len(root_pos)), *[np.repeat(r, n) for _, _, r, n in many]])
    place = np.where(root < 0, root, np.append(rank, 0)[np.maximum(root, 0)])
    order = np.lexsort((place, far, new_key))
    gap = np.searchsorted(key, new_key[order], "right")
    return np.insert(pos, gap, new_pos[order]), np.insert(wanted, gap, True)


def _sorted_names(names: np.ndarray, distinct: int, memory: int, base: int, stats: Stats, depth: int) -> np.ndarray:
    """The suffix array of a string of names that ends with its only 0."""
    n = len(names)
    small, same = _types(names), _same_before(names)
    stars = _sorted_stars(names, small, distinct - 1, memory, base, stats, depth)
    count = scratch(distinct, np.int64)
    count[:] = 0
    for s, e in batches(n):
        own, times = np.unique(names[s:e], return_counts=True)
        count[own] += times
    cum = np.cumsum(count)
    # a name with many suffixes is a range of its own
    cuts = np.searchsorted(cum, np.arange(0, int(cum[-1]), _RANGE), "right")
    big = np.flatnonzero(count > _RANGE)
    cuts = np.unique(np.concatenate([cuts, big, big + 1, [0, distinct]]))
    star_at = np.searchsorted(_gathered(names, stars), cuts)

    def feed(queue: DiskQueue, want: bool, pos: np.ndarray, outside_low: int, outside_high: int) -> None:
        """Queue what a batch of its range induces outside of it."""
        before = np.maximum(pos, 1).astype(pos.dtype) - pos.dtype.type(1)
        c = names[before]
        at = np.flatnonzero((pos > 0) & ((c < outside_low) | (c >= outside_high)))
        at = at[small[before[at]] == want]
        if not len(at):
            return
        before, c = before[at], c[at]
        r = np.searchsorted(cuts, c, "right") - 1
        order = np.argsort(r.astype(np.uint16) if len(cuts) < 1 << 16 else r, kind="stable")
        r, before, c = r[order], before[order], c[order]
        cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(r)], strict=True):
            queue.push(int(r[x]), before[x:y], c[x:y])

    def joined(queue: DiskQueue, r: int) -> tuple[np.ndarray, np.ndarray]:
        own = list(queue.pop(r))
        return tuple(np.concatenate(x) for x in zip(*own, strict=True)) if own else (stars[:0], names[:0])

    queue, kept = DiskQueue(memory, stats), DiskQueue(memory, stats)
    for r, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        s, e = int(star_at[r]), int(star_at[r + 1])
        if high - low == 1 and count[low] > _RANGE:
            for pos, own in queue.pop(r):
                kept.push(r, pos, own)
                feed(queue, False, pos, 0, 0)  # the name itself too: popped in turn
            for x, y in batches(e - s):
                feed(queue, False, np.asarray(stars[s + x : s + y]), low, high)
        else:
            here = np.asarray(stars[s:e])
            pos, wanted = _settled(names, small, same, False, joined(queue, r), (here, names[here]), low, high, 1)
            kept.push(r, pos[wanted].astype(stars.dtype), names[pos[wanted]])
            feed(queue, False, pos.astype(stars.dtype), low, high)
    queue.close()
    out, end = scratch(n, stars.dtype), n
    queue = DiskQueue(memory, stats)
    for r in range(len(cuts) - 2, -1, -1):
        low, high = int(cuts[r]), int(cuts[r + 1])
        if high - low == 1 and count[low] > _RANGE:
            for pos, _ in queue.pop(r):
                out[end - len(pos) : end] = pos[::-1]
                end -= len(pos)
                feed(queue, True, pos, 0, 0)
            for pos, _ in kept.reversed(r):
                out[end - len(pos) : end] = pos
                end -= len(pos)
                feed(queue, True, pos[::-1], low, high)
        else:
            down = joined(kept, r)
            pos, _ = _settled(names, small, same, True, joined(queue, r), (down[0][::-1], down[1][::-1]), low, high, -1)
            if low == 0:  # the end mark is induced by nothing
                pos = np.append(pos, n - 1)
            out[end - len(pos) : end] = pos[::-1]
            end -= len(pos)
            feed(queue, True, pos.astype(stars.dtype), low, high)
    queue.close()
    kept.close()
    return out


def _gathered(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = scratch(len(at), values.dtype)
    for s, e in batches(len(at)):
        out[s:e] = values[at[s:e]]
    return out


# -- the text's own level ---------------------------------------------------------------------------


def _range_min(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima over [left, right] from doubling tables."""
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), np.uint8)
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(table[k][left[m]], table[k][right[m] - (1 << int(k)) + 1])
    return out


class _Inducer:
    """Takes the inducing sequence batch by batch and queues the suffixes that begin one character earlier."""

    def __init__(self, text, small, want: bool, queue: DiskQueue, cap: int, chars: int):
        self.text, self.small, self.want, self.queue, self.cap = text, small, want, queue, cap
        self.since = np.full(chars, -1, np.int16)  # least common prefix since a character was queued; -1: never

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for s, e in batches(len(pos)):
            self._feed(pos[s:e], lcp[s:e])

    def _feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = np.maximum(pos, 1) - pos.dtype.type(1)
        at = np.flatnonzero((self.small[before] == self.want) & (pos > 0))
        least = int(lcp.min())
        if not len(at):
            np.minimum(self.since, least, out=self.since, where=self.since >= 0)
            return
        char = self.text[before[at]]
        order = np.argsort(char.astype(np.uint8) if len(self.since) <= 256 else char, kind="stable")
        at, char = at[order], char[order]
        head = np.append(True, char[1:] != char[:-1])
        heads = np.flatnonzero(head)
        out = np.empty(len(at), np.int16)
        rest = np.flatnonzero(~head)
        if len(rest):
            table, k = [lcp], 1
            widest = int((at[rest] - at[rest - 1]).max())
            while 2 * k <= widest:
                table.append(np.minimum(table[-1][:-k], table[-1][k:]))
                k *= 2
            out[rest] = _range_min(table, at[rest - 1] + 1, at[rest])
        present = char[heads].astype(np.int64)
        known = self.since[present]
        first = np.minimum(known, np.minimum.accumulate(lcp)[at[heads]])
        out[heads] = np.where(known < 0, -1, first)
        value = np.minimum(out + 1, self.cap).astype(np.uint8)
        ends = np.append(heads[1:], len(at))
        np.minimum(self.since, least, out=self.since, where=self.since >= 0)
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1][1:], np.uint8(255))
        self.since[present] = tail[at[ends - 1]]
        earlier = before[at]
        for c, s, e in zip(present.tolist(), heads.tolist(), ends.tolist(), strict=True):
            self.queue.push(c, earlier[s:e], value[s:e])


def suffix_array(text: np.ndarray, cap: int, memory: int = MEMORY, base: int = BASE, stats: Stats | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, common prefix with the one before, up to ``cap`` < 255).

    ``text`` holds integers from 0 to 65,535 and ends with 0, which occurs nowhere else.
    """
    n, stats = len(text), stats or Stats()
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    small = _types(text)
    count = sum(np.bincount(text[s:e], minlength=1 << 16) for s, e in batches(n))
    alphabet = np.flatnonzero(count).tolist()
    top = alphabet[-1] + 1
    stars = _sorted_stars(text, small, top - 1, memory, base, stats, 0)
    shared = scratch(len(stars), np.uint8)
    shared[0] = 0
    for s, e in batches(len(stars)):
        a = max(s, 1)
        shared[a:e] = _common(text, stars[a - 1 : e - 1], stars[a:e], cap)
    star_at = np.searchsorted(_gathered(text, stars), np.arange(top + 1)).tolist()

    queue, kept = DiskQueue(memory, stats), DiskQueue(memory, stats)
    make = _Inducer(text, small, False, queue, cap, top)
    for c in alphabet:
        last = None
        for pos, lcp in queue.pop(c):
            kept.push(c, pos, lcp)
            make.feed(pos, lcp)
            last = pos[-1]
        for x, y in batches(star_at[c + 1] - star_at[c]):
            s, e = star_at[c] + x, star_at[c] + y
            here, lcp = np.asarray(stars[s:e]), np.array(shared[s:e])
            if not x:
                lcp[0] = 0 if last is None else _common(text, np.array([last]), here[:1], cap)[0]
            make.feed(here, lcp)

    out, lcps = scratch(n, stars.dtype), scratch(n, np.uint8)
    end = n
    queue.close()
    queue = DiskQueue(memory, stats)
    make = _Inducer(text, small, True, queue, cap, top)
    for c in alphabet[::-1]:
        # S-suffixes, from the largest down; each block's values are common prefixes with the larger neighbour
        edge = carried = None  # the smallest suffix of this character so far; its common prefix with the one below
        if c == 0:
            end -= 1
            out[end], lcps[end] = n - 1, 0
            break
        for pos, lcp in queue.pop(c):
            make.feed(pos, lcp)
            m = len(pos)
            out[end - m : end] = pos[::-1]
            # value i is shared with the entry before it in this order, which is the next larger one
            if edge is not None:
                lcps[end] = lcp[0]
            lcps[end - m + 1 : end] = lcp[1:][::-1]
            end -= m
            edge = pos[-1]
        for pos, lcp in kept.reversed(c):
            m = len(pos)
            down = np.empty(m, np.uint8)  # with the next larger
            down[1:] = lcp[:0:-1]
            down[0] = 0 if edge is None else (carried if carried is not None else _common(text, pos[-1:], np.array([edge]), cap)[0])
            make.feed(pos[::-1], down)
            if edge is not None:
                lcps[end] = down[0]
            out[end - m : end] = pos
            lcps[end - m + 1 : end] = lcp[1:]
            end -= m
            edge, carried = pos[0], lcp[0]
        lcps[end] = 0
    queue.close()
    kept.close()
    return out, lcps
