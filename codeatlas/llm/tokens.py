"""Token ids of a word-level BPE tokenizer file, vectorised over many texts.

The tokenizer splits lower-cased text into words independently of context, so a word's ids need to be
found once: words are cut out with numpy, hashed, and looked up in a bounded cache; only unseen words
reach the tokenizer's model. Texts with code points for which normalisation is not a plain per-character
lower-casing, or with the text of a special token, go through the library's own ``encode``.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from .common import buffers, mix64

SPACE, LETTER, NUMBER, OTHER, UNSAFE = 0, 1, 2, 3, 4
_TOP = 0x250  # code points below it are in NFC whatever stands beside them
_M = 0x9E3779B97F4A7C15 | 1


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, low = np.full(_TOP + 1, UNSAFE, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
    for c in range(_TOP):
        category = unicodedata.category(chr(c))
        if chr(c) in "\t\n\r ":
            kind[c] = SPACE
        elif category[0] == "C" or category[0] == "Z" or len(chr(c).lower()) != 1 or ord(chr(c).lower()) >= _TOP:
            continue
        else:
            kind[c] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
            low[c] = ord(chr(c).lower())
    return kind, low


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Ids for batches of texts; ``path`` names the tokenizer file, ``most`` bounds the words that are kept."""

    def __init__(self, path: str, most: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        kinds = [x["type"] for x in (shape.get("normalizer") or {}).get("normalizers", [])]
        # the vectorised way holds for this kind of file only
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and bool(shape["model"].get("end_of_word_suffix"))
        self.special = [x["content"] for x in shape.get("added_tokens", [])]
        self.kind, self.low = _classes()
        self.letter = np.random.default_rng(7).integers(1, 1 << 63, _TOP + 1, dtype=np.uint64)
        self.bytes = str.maketrans(_byte_letters())
        self.power = np.ones(1, np.uint64)
        self.back = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 2 * len(self.power), 1 << 20)
            for name, m in (("power", _M), ("back", pow(_M, -1, 1 << 64))):
                steps = np.full(size, m, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        model = self.tokenizer.model
        found = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(self.bytes))] for w in words]
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(count.sum()))
        first = len(self.ids) + np.cumsum(count) - count
        slot = len(self.first) + np.arange(len(keys))
        self.first, self.count, self.ids = np.concatenate([self.first, first]), np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slot)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offset of each text's ids) for a null-free large_string array."""
        n = len(texts)
        ends, raw = buffers(texts)
        if not self.plain:
            return self._own([texts[i].as_py() for i in range(n)])
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        doc = heads[ends]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        clipped = np.minimum(points, _TOP)
        kind = self.kind[clipped]
        odd = np.zeros(n, bool)
        bad = np.flatnonzero(kind == UNSAFE)
        if self.special:
            bad = np.concatenate([bad, np.flatnonzero((clipped[:-1] == ord("<")) & (clipped[1:] == ord("|")))])
        odd[np.searchsorted(doc, bad, "right") - 1] = True
        kind = np.where(kind == UNSAFE, SPACE, kind)
        low = self.low[clipped]
        ids, counts = self._words(low, kind, doc)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if odd.any():
            parts, own = np.split(ids, offsets[1:-1]), np.flatnonzero(odd)
            some, at = self._own([texts[int(i)].as_py() for i in own])
            for k, i in enumerate(own):
                parts[i] = some[at[k] : at[k + 1]]
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets

    def _own(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _words(self, low: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(low)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(doc) - 1, np.int64)
        fresh = np.zeros(n + 1, bool)
        fresh[doc] = True
        begin = np.empty(n, bool)
        begin[0] = True
        begin[1:] = kind[1:] != kind[:-1]
        begin |= fresh[:-1] | (kind == NUMBER)
        self._contractions(low, kind, begin, fresh)
        word = begin & (kind != SPACE)
        breaks = np.flatnonzero(begin)  # a space run begins too
        nth = np.flatnonzero(word[breaks])
        start = breaks[nth]
        end = np.append(breaks, n)[nth + 1]
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letter[low] * self.power[:n], out=total[1:])
        key = mix64((total[end] - total[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        unique, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        new = self._missing(unique)
        if len(new):
            at = where[new]
            self._learn(unique[new], [low[s:e].tobytes().decode("utf-32-le") for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            again = self._missing(unique)
            if len(again):  # the cache was emptied to stay in its bound
                at = where[again]
                self._learn(unique[again], [low[s:e].tobytes().decode("utf-32-le") for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        slot = self.slot[np.searchsorted(self.keys, unique)][inverse]
        count, first = self.count[slot], self.first[slot]
        ahead = np.cumsum(count)
        ids = self.ids[np.repeat(first - (ahead - count), count) + np.arange(int(ahead[-1]) if len(ahead) else 0)]
        per = np.concatenate([[0], ahead])[np.searchsorted(start, doc)]
        return ids, np.diff(per)

    def _missing(self, unique: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(unique))
        at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != unique)

    @staticmethod
    def _contractions(low, kind, begin, fresh) -> None:
        """A lone apostrophe takes s, t, m, d or re, ve, ll of the letters that follow as one word."""
        n = len(low)
        at = np.flatnonzero((low == ord("'")) & begin)
        at = at[at + 1 < n]
        at = at[(kind[at + 1] == LETTER) & ~fresh[at + 1]]
        if not len(at):
            return
        one = np.isin(low[at + 1], [ord(c) for c in "stmd"])
        third = np.where(at + 2 < n, low[np.minimum(at + 2, n - 1)], 0)
        same = (at + 2 < n) & ~fresh[np.minimum(at + 2, n)]
        two = ~one & same & (((low[at + 1] == ord("r")) | (low[at + 1] == ord("v"))) & (third == ord("e")) | (low[at + 1] == ord("l")) & (third == ord("l")))
        for chosen, size in ((at[one], 2), (at[two], 3)):
            for k in range(1, size):
                begin[chosen + k] = False
            after = chosen + size
            begin[after[after < n]] = True
