"""The pipeline's stages, one after another, each against brute force on its own input, and over awkward tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_classes, words

import corpus_pipeline
from codeatlas.llm import mixing, packing, toxicity
from codeatlas.llm.tokens import WordTokens

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    """Texts without the pairs of lines that stand in a smaller doc_id, or earlier in the same text."""
    first = {}
    texts = [(-(2**63) if i is None else i, t or "") for i, t in rows]
    for i, t in sorted(texts, key=lambda x: x[0]):
        own = t.split("\n")
        for a, b in zip(own, own[1:], strict=False):
            first.setdefault((a, b), i)
    out = []
    for i, t in texts:
        own, here = t.split("\n"), {}
        gone = set()
        for n, pair in enumerate(zip(own, own[1:], strict=False)):
            if first[pair] < i or here.setdefault(pair, n) <= n - 2:
                gone |= {n, n + 1}
        out.append((i, "\n".join(x for n, x in enumerate(own) if n not in gone)))
    return out


def test_stages_equal_brute_force(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    extra = [(10**6 + i, t, "en", s, len(t or ""), 7) for i, (t, s) in enumerate([(None, None), ("", "src1"), ("one", "src1"), ("one", None), (words(1, 9) + "\n" + words(2, 9), "src2"), (words(3, 9) + "\n" + words(1, 9) + "\n" + words(2, 9), "src2")])]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit(7)).unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, size int"))
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)

    kept = corpus_pipeline.toxicity(spark, docs, SF)
    flagged = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    all_ = docs.collect()
    assert kept.columns == docs.columns and key(kept.collect()) == key([r for r in all_ if r.doc_id not in flagged])

    lines = corpus_pipeline.line_dedup(spark, kept, SF)
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    got = lines.collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted(want) and lines.columns == docs.columns
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)

    near = corpus_pipeline.near_dedup(spark, lines, SF)
    roots = {i: root for i, _, root in brute_classes([(r.doc_id, r.text) for r in got], 5)}
    assert key(near.collect()) == key([r for r in got if roots[r.doc_id] == r.doc_id]) and near.columns == docs.columns

    mixed = corpus_pipeline.mixing(spark, near, SF)
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.pivotal_mix(near).collect():
        assert copies[r.doc_id] == (r.copies if r["size"] else 1)
    assert mixed.columns == docs.columns

    packed = corpus_pipeline.packing(spark, mixed, SF).collect()
    w, asked = WordTokens(packing.default_tokenizer()), Counter()
    for r in mixed.collect():
        ids = np.append(np.array(w.tokenizer.encode(r.text or "", add_special_tokens=False).ids, np.uint32), np.uint32(0))
        asked.update((r.doc_id, p, s, len(x := ids[s : s + 2048]), zlib.crc32(x.astype("<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048)))
    assert Counter(tuple(r)[:5] for r in packed) == asked
    fill = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in fill.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 2048


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_awkward_tables(spark, stage):
    shape = "doc_id long, text string, lang string, source string, n_chars long, k long, score double, size int, h1 string, parts int, copies string, revisit int"
    rows = [(i, t, None, s, None, 1, 0.5, 2, "h", 3, "c", 4) for i, t, s in [(None, None, None), (1, "", ""), (2, "a b c", "x"), (2, "a b c", "x"), (2, "d e f\ng", "x"), (3, "ab " * 60_000, "x"), (None, "a b c", None), (4, " \n\t", "y")]]
    docs = spark.createDataFrame(rows, shape)
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, docs, SF).collect()
    ids = Counter(r.doc_id for r in got)
    if stage in ("toxicity", "line_dedup"):
        assert ids == Counter(r[0] for r in rows)
    if stage == "near_dedup":
        assert ids == Counter([None, None, 1, 2, 3, 4] + [2] * (ids[2] - 1)) and ids[2] >= 1
    if stage == "mixing":
        assert all(n <= 3 * sum(r[0] == i for r in rows) for i, n in ids.items()) and ids[1] == ids[4] == 1
    if stage != "packing":
        assert run(spark, docs, SF).columns == docs.columns and all((r.h1, r.k, r.revisit) == ("h", 1, 4) for r in got)
    else:
        assert set(ids) == {None, 1, 2, 3, 4}
    assert run(spark, docs.limit(0), SF).count() == 0
    with pytest.raises(ValueError, match="__ca_"):
        run(spark, docs.withColumn("__ca_k", F.lit(1)), SF)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got[0].asDict()) and len({r.doc_id for r in got}) > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
