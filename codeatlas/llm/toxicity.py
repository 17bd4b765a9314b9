"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text. The ordinary one is trained by zstandard on windows of
ordinary texts. The toxic one holds the passages that toxic texts repeat and ordinary ones lack, found by a
likelihood ratio: dictionaries that zstandard's trainer made of toxic text were tried, alone or behind the ordinary
one, and told the classes apart worse, because the trainer spends its bytes on what both classes share (the README
has the figures). A document is cut into short windows; each is compressed with the ordinary dictionary alone and
with the toxic one before it, and the bytes saved are the evidence. Thresholds on the savings (the largest, and how
many windows reach 1, 2 and 3 bytes) are calibrated by a logistic fit into a score.

Fitting uses at most ``FIT_TOXIC`` + ``FIT_ORDINARY`` labelled documents (those with the smallest hash of doc_id)
and ``FIT_WINDOWS`` of their ordinary windows, evenly spaced, in one task; every document is scored over its whole
text. Labels, lang, source and doc_id are no inputs of a score.

Cases: null and empty texts have no window and get the score of a text without evidence; rows with equal
text get equal scores; where one class has no label, every score is 0; labels with a null doc_id or class
are ignored, and of several labels of a document the largest counts; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, table

#: Labelled documents that a fit uses at most, by class; windows of the ordinary ones that its dictionary is trained on at most.
FIT_TOXIC, FIT_ORDINARY, FIT_WINDOWS = 2000, 3000, 40_000
#: Bytes of the ordinary dictionary and of a window; zstandard's level; savings of a window that count at most.
DICTIONARY, WINDOW, LEVEL, MOST = 60_000, 40, 12, 12
#: Log-likelihood ratio from which a beginning of a word counts as typical of toxic text.
EVIDENCE, CUT = 14.0, 0.7
_LETTERS = re.compile(r"[^\W\d_]+")


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The text in lower case, white space collapsed, cut at spaces into pieces of about ``size`` bytes."""
    b = " ".join(text.lower().split()).encode()
    out, i, n = [], 0, len(b)
    while i < n:
        j = b.find(b" ", i + size, i + 2 * size)
        if j < 0:
            j = min(n, i + size + size // 2)
        out.append(b" " + b[i:j] + b" ")
        i = j + (j < n and b[j] == 32)
    return out


def _beginnings(word: str) -> list[str]:
    return [word[:k] for k in range(4, min(len(word), 12) + 1)] + [word + " "]


def typical(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Beginnings of words that toxic texts repeat, after different words, and ordinary texts lack.

    Counting the words before it makes a passage that was copied into many texts count once.
    """
    counts, totals = [], []
    for texts in (toxic, ordinary):
        met: set[tuple[str, str]] = set()
        for t in texts:
            before = ""
            for w in _LETTERS.findall(t.lower()):
                met.add((before, w))
                before = w
        c: Counter[str] = Counter()
        for _, w in met:
            c.update(_beginnings(w))
        counts.append(c)
        totals.append(len(met))
    share = totals[0] / max(1, sum(totals))

    def strong(g: str) -> bool:
        t, o = counts[0][g], counts[1][g]
        n = t + o
        if t * (1 - share) <= 10 * share * (o + 0.5):
            return False
        ratio = t * math.log(t / (n * share)) + (o * math.log(o / (n * (1 - share))) if o else 0.0)
        return ratio >= EVIDENCE

    good = {g for g in counts[0] if strong(g)}
    follow: dict[str, list[str]] = {}
    for g in good:
        follow.setdefault(g[:-1], []).append(g)
    out = set()
    for g in good:
        if g[:-1] in good:
            continue
        while longer := [h for h in follow.get(g, ()) if counts[0][h] >= 0.9 * counts[0][g]]:
            g = max(longer, key=lambda h: (counts[0][h], h))
        out.add(g)
    return sorted(out, key=lambda g: (counts[0][g], g))


class CompressionModel:
    """The two dictionaries and the calibration."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary, self.weights, self.scale = toxic, ordinary, None, None
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _compressors(self):
        if self._ready is None:
            import zstandard as z

            made = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                given = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                params = z.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(self.toxic) + len(self.ordinary), source_size=WINDOW * 3 // 2, write_content_size=0, write_checksum=0, write_dict_id=0)
                given.precompute_compress(compression_params=params)
                made.append(z.ZstdCompressor(compression_params=params, dict_data=given))
            self._ready = made
        return self._ready

    def savings(self, pieces: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        if not pieces:
            return np.zeros(0, np.int64)
        sizes = []
        for c in self._compressors():
            r = c.multi_compress_to_buffer(pieces, threads=1)
            sizes.append(np.fromiter((len(r[i]) for i in range(len(r))), np.int64, len(r)))
        return sizes[0] - sizes[1]

    def features(self, texts: list[str]) -> np.ndarray:
        cut = [windows(t) for t in texts]
        ends = np.cumsum([len(c) for c in cut])
        saved = self.savings([w for c in cut for w in c])
        out = np.zeros((len(texts), 5))
        for i, (end, own) in enumerate(zip(ends, cut, strict=True)):
            s = saved[end - len(own) : end]
            out[i] = (min(s.max(initial=0), MOST), *(math.log1p((s >= k).sum()) for k in (1, 2, 3)), math.log1p(len(own)))
        return out

    def fit(self, texts: list[str], labels: np.ndarray, weight: np.ndarray) -> None:
        x = self.features(texts)
        mean, std = x.mean(0), x.std(0) + 1e-9
        x = np.c_[(x - mean) / std, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        ridge = np.r_[np.full(len(w) - 1, 0.1), 1e-6]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - labels)) + ridge * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
            step = np.linalg.solve(h, g)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.weights, self.scale = w, (mean, std)

    def scores(self, texts: list[str]) -> np.ndarray:
        mean, std = self.scale
        x = np.c_[(self.features(texts) - mean) / std, np.ones(len(texts))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def train(toxic: list[str], ordinary: list[str], share: float) -> CompressionModel | None:
    """A model of labelled texts; ``share`` is the part of toxic ones among all labels."""
    if not toxic or not ordinary:
        return None
    import zstandard as z

    samples = [w for t in ordinary for w in windows(t)]
    samples = samples[:: -(-len(samples) // FIT_WINDOWS) or 1]
    try:
        base = z.train_dictionary(DICTIONARY, samples, k=64, d=8).as_bytes()[-DICTIONARY:]
    except z.ZstdError:  # too few samples for the trainer
        base = b"".join(samples)[-DICTIONARY:] or b" "
    # The dictionaries are trained on half of the texts and calibrated on the other half.
    own = "".join(" " + g for g in typical(toxic[::2] or toxic, ordinary[::2] or ordinary)).encode()
    trial = CompressionModel(own + b" ", base)
    kept = (toxic[1::2] or toxic, ordinary[1::2] or ordinary)
    y = np.r_[np.ones(len(kept[0])), np.zeros(len(kept[1]))]
    weight = np.where(y > 0, share / len(kept[0]), (1 - share) / len(kept[1])) * len(y)
    trial.fit([*kept[0], *kept[1]], y, weight)
    # The final dictionary has seen all of them; its calibration is the trial's.
    final = CompressionModel("".join(" " + g for g in typical(toxic, ordinary)).encode() + b" ", base)
    final.weights, final.scale = trial.weights, trial.scale
    return final


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, ordinary: int = FIT_ORDINARY) -> bytes | None:
    """The pickled model of a bounded sample of the labels outside the held-out rows (None: a class is missing)."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    seen = own.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"] or not seen["t"] or seen["t"] == seen["n"]:
        return None
    share = seen["t"] / seen["n"]
    pick = [own.where(F.col("toxic") > 0 if k else F.col("toxic") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k, most in ((1, toxic), (0, ordinary))]
    ids = F.broadcast(pick[0].unionByName(pick[1]))  # at most ``toxic + ordinary`` rows
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(ids, "doc_id")
    sample = sample.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        t.sort()
        made = train([x[1] for x in t if x[2] > 0], [x[1] for x in t if x[2] <= 0], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made) if made else None], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return made["model"] if made else None


def score(docs: DataFrame, model: bytes | None, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` with the score as ``name``; ``text`` must be among them."""
    schema = docs.select(*columns).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model) if model else None
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text", 256 << 10):
                s = m.scores(texts.to_pylist()) if m else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s)], names=[*columns, name])

    return docs.select(*columns).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, fit(docs, labels), ["doc_id", "text"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without those whose score reaches ``cut``."""
    return score(docs, fit(docs, labels), docs.columns, "__ca_score").where(F.col("__ca_score") < cut).drop("__ca_score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
