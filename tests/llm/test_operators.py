"""Each operator against brute force or an exact round trip, and over the awkward cases: nulls, empty and very
long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import io
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeatlas.llm import components, fingerprints, licenses, line_dedup, mixing, near_dedup, packing, substring_dedup, suffix, topk, toxicity, warc
from codeatlas.llm.tokens import WordTokens

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, k long, score double, size int"
PASSAGE = "This passage is certainly longer than fifty bytes, so that it counts.\nAnd it has a second line, which is long as well.\nAnd a third."


def words(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(1, 300)
    near = base.replace(base.split()[150], "changed")
    out = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, near, "en", "b"), (3, None, None, None), (4, "", "en", "b"), (5, "one", "en", "b"), (6, "One", "en", ""),
        (7, words(2, 60) + "\n" + PASSAGE + "\n" + words(3, 60), "fr", "b"), (8, words(4, 50) + "\n" + PASSAGE, "fr", None), (9, "é" * 70 + " ß", "de", "c"), (10, "ab" * 40_000, "en", "c"),
        (11, "Released under the MIT License.\n" + words(5, 20), "en", "c"), (None, words(6, 40), "en", "c"), (12, words(7, 9), "en", "c"), (12, words(7, 9), "en", "c"), (13, " \t\n", "en", "c"),
    ]
    return [(i, t, lang, s, len(t or ""), 1, 0.5, 3) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    from codeatlas.session import ship

    return ship(spark).createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


# -- 1 --------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=90), st.booleans(), st.sampled_from([(1 << 18, 1 << 17, 1 << 20), (7, 5, 4), (3, 2, 30)]), st.integers(1, 20))
def test_suffix_array(values, repeat, bounds, spread):
    t = [v * spread for v in values] * (2 if repeat else 1) + [0]
    kept = suffix._BATCH, suffix._RANGE, suffix.HELD
    suffix._BATCH, suffix._RANGE, suffix.HELD = bounds
    try:
        order, shared = suffix.suffix_array(np.array(t, np.uint16), 20, 64 if bounds[0] < 10 else 1 << 20, 4 if bounds[0] < 10 else 1 << 20)
    finally:
        suffix._BATCH, suffix._RANGE, suffix.HELD = kept
    want = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0]
    for a, b in zip(want, want[1:], strict=False):
        k = 0
        while k < 20 and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        common.append(k)
    assert order.tolist() == want and shared.tolist() == common


def brute_spans(rows, span=50):
    first, out = {}, []
    for i, text in sorted(((-(2**63) if r[0] is None else r[0], (r[1] or "").encode()) for r in rows), key=lambda x: x[0]):
        hit = [j for j in range(len(text) - span + 1) if first.setdefault(text[j : j + span], i) < i]
        kept = bytearray(b"\1" * len(text))
        for j in hit:
            kept[j : j + span] = bytes(span)
        rest = bytes(c for c, k in zip(text, kept, strict=True) if k)
        spans = len(re.findall(b"\0+", bytes(kept)))
        out.append((None if i == -(2**63) else i, len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(docs, rows, none):
    got = substring_dedup.remove_repeated(docs).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute_spans(rows)
    assert substring_dedup.remove_repeated(none).count() == 0


def test_substring_dedup_of_rows_that_share_an_id(spark):
    p = words(31, 40)
    rows = [(1, p), (2, p + " tail A"), (2, "Z" * 200), (2, p[:80]), (3, words(32, 30)), (3, "y" + "Z" * 120), (3, None), (4, words(32, 30)), (4, words(32, 30)), (4, p[40:120])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("own")).repartition(4)
    assert sorted(map(tuple, substring_dedup.remove_repeated(d).drop("spans").collect()), key=str) == brute_spans(rows)


def test_substring_dedup_of_hot_segments(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PLACES", 7)
    rows = [(i, words(900 + i, 6) + "\n" + PASSAGE + "\n" + words(300 + i % 5, 12)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring_dedup.remove_repeated(d).drop("spans").collect()), key=str) == brute_spans(rows)


def test_shards_beyond_the_memory_of_a_queue():
    """With the constants of production the queues spill, names recurse, and memory stays bounded as the shard grows."""
    r = np.random.default_rng(2)
    text = bytes(r.integers(97, 105, 1 << 21, dtype=np.uint8))
    segs = [text[i : i + 67] for i in range(0, len(text) - 67, 34)] + [text[i : i + 120] for i in range(0, len(text) // 4, 300)]
    stats = suffix.Stats()
    seg, a, b, first = substring_dedup.earliest(np.frombuffer(b"".join(segs), np.uint8), np.cumsum([len(x) for x in segs]), np.arange(len(segs))[::-1].copy(), 50, stats=stats)
    assert stats.spills > 100 and stats.depth > 1 and sum(map(len, segs)) > 4 * suffix.MEMORY
    least, got = {}, {}
    for i, s in enumerate(segs):
        for j in range(len(s) - 49):
            least[s[j : j + 50]] = min(least.get(s[j : j + 50], len(segs)), len(segs) - 1 - i)
    for i, x, y, f in zip(seg.tolist(), a.tolist(), b.tolist(), first.tolist(), strict=True):
        for j in range(x, y + 1):
            got[i, j] = f
    assert got == {(i, j): least[s[j : j + 50]] for i, s in enumerate(segs) for j in range(len(s) - 49)}


# -- 2 --------------------------------------------------------------------------------------------


def test_tokens_agree_with_the_library():
    w = WordTokens(packing.default_tokenizer())
    texts = ["It's 'street ''s re've 1234 naïve Ωmega İ ß", "", "  ", "a <|endoftext|> b", "tab\tnew\nline 'LL", "日本語", "x" * 300, "ʼn 'l 'r", words(8, 500)]
    ids, at = w.encode(pa.array(texts, pa.large_string()))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [list(x.ids) for x in w.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_is_optimal_on_small_cases(lengths):
    def fits(bins, todo):
        if not todo:
            return True
        return any(fits(bins[:i] + [b - todo[0]] + bins[i + 1 :], todo[1:]) for i, b in enumerate(bins) if b >= todo[0] and b not in bins[:i])

    best = next(n for n in range(1, 10) if fits([20] * n, sorted(lengths, reverse=True)))
    of, place, fill = packing.assign(np.array(lengths), 20)
    assert len(fill) == best and fill.max() <= 20
    for b in range(len(fill)):
        at = sorted((int(p), x) for p, x, o in zip(place, lengths, of, strict=True) if o == b)
        assert [p for p, _ in at] == [sum(x for _, x in at[:i]) for i in range(len(at))]


def test_packing(docs, rows, none):
    w = WordTokens(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    want = []
    for r in rows:
        ids = np.append(np.array(w.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, np.uint32), np.uint32(0))
        want += [(r[0], p, s, len(x := ids[s : s + 2048]), zlib.crc32(x.astype("<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(g)[:5] for g in got), key=str) == sorted(want, key=str)
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    assert len(by) == -(-sum(x[3] for x in want) // 2048)
    for pieces in by.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 2048
    assert packing.pack_documents(none).count() == 0


# -- 3 --------------------------------------------------------------------------------------------


def test_top_k(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 6)], 1) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] + [0.0] * 5, 1), (350, rows[7][1], 1), (351, rows[7][1], 1), (None, rows[3][1], 1), (400, [0.0] * 6, 1), rows[5]]
    v = spark.createDataFrame([(*x, 1, "b") for x in rows], "vec_id long, embedding array<double>, score int, least int, block string")
    fine = {i: np.floor(np.array(e) * 256).astype(int) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = set()
    for i in fine:
        if i % 50 == 0:
            ranked = sorted(((-int(fine[i] @ fine[j]), j) for j in fine if j != i))[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)}
    for cut in (16384, 40, 7):
        assert {tuple(x) for x in topk.top_k(v, rows=cut).collect()} == want
    assert topk.top_k(v.limit(0)).count() == 0
    assert topk.top_k(v.where("vec_id IN (0, 1, 2)")).count() == 2


# -- 4 --------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, none):
    r = np.random.default_rng(3)
    bad = ["snarkle", "grumbot", "vileness"]
    texts = []
    for i in range(400):
        w = words(100 + i, 60).split()
        if i % 4 == 0:
            for b in bad:
                w.insert(int(r.integers(0, len(w))), b)
        texts.append((i, " ".join(w)))
    d = spark.createDataFrame([*texts, (400, None), (401, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_documents(d, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(400)) and all(0 <= x.score <= 1 for x in got.values())
    right = [got[i].predicted == int(i % 4 == 0) for i in held]
    assert sum(right) >= 0.95 * len(right) and got[400].score == got[401].score and got[400].predicted == 0
    assert toxicity.score_documents(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.score_documents(none, labels).count() == 0
    assert sorted(toxicity.drop_toxic(docs, labels).columns) == sorted(docs.columns)


def test_toxicity_savings_and_scores_by_hand():
    import zstandard as z

    texts = [words(700 + i, 30) + (" snarkle grumbot" * 2 if i % 3 == 0 else "") for i in range(120)] + ["", "x" * 30_000, "é ß " * 50]
    model = toxicity.train([t for i, t in enumerate(texts) if i % 3 == 0], [t for i, t in enumerate(texts) if i % 3], 0.3)
    size = len(model.toxic) + len(model.ordinary)
    params = z.ZstdCompressionParameters.from_level(toxicity.LEVEL, dict_size=size, source_size=toxicity.WINDOW * 3 // 2, write_content_size=0, write_checksum=0, write_dict_id=0)

    def length(piece, given):
        d = z.ZstdCompressionDict(given, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return len(z.ZstdCompressor(compression_params=params, dict_data=d).compress(piece))

    for t in [*texts[:6], *texts[-3:]]:
        cut = toxicity.windows(t)
        assert b"".join(c[1:-1].replace(b" ", b"") for c in cut) == "".join(t.lower().split()).encode()
        saved = [length(c, model.ordinary) - length(c, model.toxic + model.ordinary) for c in cut]
        assert model.savings(cut).tolist() == saved
        seen = [min(max(saved, default=0), 12) if saved and max(saved) > 0 else 0, *(math.log1p(sum(x >= k for x in saved)) for k in (1, 2, 3)), math.log1p(len(cut))]
        assert model.features([t])[0].tolist() == pytest.approx(seen)
        x = np.append((np.array(seen) - model.scale[0]) / model.scale[1], 1)
        assert model.scores([t])[0] == pytest.approx(1 / (1 + math.exp(-float(np.clip(x @ model.weights, -30, 30)))))
    assert model.scores([texts[0]])[0] > 0.7 > model.scores([texts[1]])[0]


# -- 5 --------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    block = "\n".join(words(20 + i, 9) for i in range(30))
    a, b = words(140, 8) + "\n" + words(141, 8), "\n".join(words(150 + i, 7) for i in range(3))
    rows = [(1, a + "\n" + block), (2, b + "\n" + block + "\n" + words(60, 5)), (3, "just one line"), (4, "just one line"), (5, None), (6, ""), (None, words(61, 4)), (7, block + "\n" + block)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("k", F.lit("x"))
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(d).collect()}
    assert out[1].text == a + "\n" + block and out[3].text == out[4].text == "just one line" and out[5].text is None and out[6].text == ""
    gone = [x for x in block.split("\n") if x not in out[2].text.split("\n")]
    assert len(gone) >= 6 and all(x in out[2].text for x in b.split("\n")) and out[2].n_chars == len(out[2].text)
    assert len(out[7].text) < len(block) and out[1].k == "x"
    # brute force over the operator's own chunks
    first, want = {}, {}
    for i, text in sorted(((-1 if i is None else i, t or "") for i, t in rows)):
        kept = []
        for s, e, n in line_dedup.chunks(pa.array([text], pa.large_string()))[0]:
            piece = text.encode()[s:e]
            if n < 2 or piece not in first:
                kept.append(piece)
            if n >= 2:
                first.setdefault(piece, i)
        want[None if i < 0 else i] = b"\n".join(kept).decode()
    assert {i: r.text or "" for i, r in out.items()} == want
    assert line_dedup.drop_repeated_lines(d.limit(0)).count() == 0


def test_line_dedup_takes_short_passages_whole(spark):
    """Passages of 2 to 8 lines amid foreign lines go from the first line to the last, and nothing else does."""
    line, rows, want, passages = iter(range(10_000, 20_000)), [], {}, []
    fresh = lambda n: [words(next(line), 7) for _ in range(n)]
    for i in range(40):
        passages.append(fresh(2 + i % 7))
        rows.append((i, want.setdefault(i, "\n".join(fresh(1 + i % 3) + passages[i] + fresh(i % 4)))))
    for i in range(40):
        head, tail = fresh(i % 4), fresh(1 + i % 3)
        rows.append((100 + i, "\n".join(head + passages[i] + tail)))
        want[100 + i] = "\n".join(head + tail)
    single, a, b, c = *fresh(1), *fresh(3)
    for i, text, left in (
        (200, f"{single}\n{a}\n{b}", f"{single}\n{a}\n{b}"), (201, f"{c}\n{single}\n{c}", f"{c}\n{single}\n{c}"), (202, "\n".join("xxxx"), "x\nx"), (203, f"{a}\n{b}", ""), (204, None, None), (205, "", ""), (206, single, single),
        (207, f"{c}\né ß\nü\n{c}\né ß\nü\n{b}\n", f"{c}\né ß\nü\n{b}\n"), (None, "o\nne", "o\nne"), (208, "one\no\nne\n", "one\n"),
    ):
        rows.append((i, text))
        want[i] = left
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).repartition(5)
    out = line_dedup.drop_repeated_lines(d, line_dedup.pairs).collect()
    assert {r.doc_id: r.text for r in out} == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    n = {r.doc_id: (r["__ca_lines"], r["__ca_removed"], r["__ca_spans"]) for r in line_dedup.dedup_lines(d, line_dedup.pairs).collect()}
    assert all(n[100 + i][1:] == (len(passages[i]), 1) for i in range(40)) and n[202] == (4, 2, 1) and n[205] == (0, 0, 0) and n[206] == (1, 0, 0)
    assert line_dedup.drop_repeated_lines(d.limit(0), line_dedup.pairs).count() == 0


# -- 6 --------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, none):
    r = np.random.default_rng(5)
    many = spark.createDataFrame([(i, words(i, int(r.integers(1, 40))), None if i % 7 == 0 else f"s{i % 5}") for i in range(1500)], "doc_id long, text string, source string")
    for d in (many, docs):
        got = mixing.pivotal_mix(d).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
        again = mixing.pivotal_mix(d.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
        assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == d.count()
        own = {}
        for x in d.collect():
            own[x.source] = own.get(x.source, 0) + len(re.findall(mixing.WORD, x.text or ""))
        order = sorted(own, key=lambda s: (s is None, s or ""))
        weight = {s: i % 3 + 1 for i, s in enumerate(order)}
        target, capped, total = {}, set(), sum(own.values())
        while True:
            rest = total - sum(3 * own[s] for s in capped)
            free = sum(weight[s] for s in order if s not in capped)
            target = {s: 3.0 * own[s] if s in capped else rest * weight[s] / free for s in order}
            more = {s for s in order if s not in capped and target[s] > 3 * own[s]}
            if not more:
                break
            capped |= more
        for s in order:
            mine = [x for x in got if x.source == s]
            assert all(x.source_size == own[s] and abs(x.target - target[s]) < 1e-6 * max(1, target[s]) for x in mine)
            assert all(x.taken in (0, x.size, 2 * x.size, 3 * x.size) for x in mine)
            assert abs(sum(x.taken for x in mine) - target[s]) <= max((x.size for x in mine), default=0)
    assert mixing.pivotal_mix(none).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


# -- 7 --------------------------------------------------------------------------------------------


def test_fingerprints(docs, rows, none):
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs.where("doc_id < 12")).collect()}
    ids = sorted(got)
    text = {r[0]: r[1] or "" for r in rows}
    for i, n in zip(ids, [*ids[1:], ids[0]], strict=True):
        new = fingerprints.edited(text[i], text[n])
        assert got[i].n_chars == len(text[i]) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        sets = [{d.tobytes() for d in fingerprints.digests([t.encode()])[0]} for t in (text[i], new, text[n])]
        dice = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
        assert got[i].near_edited == pytest.approx(dice(sets[0], sets[1])) and got[i].near_next == pytest.approx(dice(sets[0], sets[2]))
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0
    a, b = "\n".join(words(i, 6) for i in range(40)), "\n".join(words(i, 6) for i in range(5, 60))
    only = [set(x.tolist()) for x in (fingerprints.digests([a.encode()])[0], fingerprints.digests([b.encode()])[0])]
    assert [set(x) for x in fingerprints.difference(a, b)] == [only[0] - only[1], only[1] - only[0]]
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert fingerprints.fingerprint_documents(docs).count() == len(rows)


def test_ranges_meet_their_neighbours(spark):
    d = spark.createDataFrame([(i * 3, words(i, 20)) for i in range(200)], "doc_id long, text string").repartition(7)
    kept, fingerprints.RANGE = fingerprints.RANGE, 17
    try:
        placed, n = fingerprints.with_next(d, 17)
        assert n > 5 and placed.where("halo").count() == n and placed.count() == 200 + n
    finally:
        fingerprints.RANGE = kept


# -- 8 --------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "<p>" + words(1, 300) + "</p>"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "x\ny", ""), (5, "http://c", "é" * 600), (7, "http://c", "é" * 600), (8, "u", "short"), (9, "u", "short"), (10, "u", "x" * 9_000_000), (2, "http://b", big)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    members = warc.normalize_archives(warc.write_archives(warc.decided(d), 20_000))
    got = sorted(warc.read_archives(members).collect(), key=lambda r: r.page_id)
    want = []
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        b = (h or "").encode()
        last = max(j for j, _, g in rows if (g or "") == (h or ""))
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", last) if len(b) >= 1000 and i < last else ("response", None)), b if len(b) < 1000 or i == last else b""))
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.content)) for r in got] == want
    assert warc.read_archives(warc.normalize_archives(warc.write_archives(warc.decided(d.limit(0))))).count() == 0
    # a file, round trip through its index
    raws = [warc.record(i, "u", bytes([i]) * i * 50, "d", None, False) for i in range(1, 6)]
    import gzip

    source, target = tmp_path / "a.gz", tmp_path / "b.gz"
    source.write_bytes(gzip.compress(b"".join(raws[:3])) + gzip.compress(b"".join(raws[3:])))
    assert warc.normalize_file(str(source), str(target)) == 5
    data = target.read_bytes()
    for line, raw in zip((tmp_path / "b.gz.idx").read_text().splitlines(), raws, strict=True):
        _, at, n = line.split("\t")
        assert zlib.decompress(data[int(at) : int(at) + int(n)], 31) == raw
    with pytest.raises(ValueError):
        list(warc.normalize(io.BytesIO(gzip.compress(raws[0][:-9])).read))


# -- 9 --------------------------------------------------------------------------------------------


def brute_classes(rows, n, percent=80):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()))
    root = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return sorted((i, len(s), root[i]) for i, s in sets)


def test_near_dedup(spark, docs, rows, none):
    some = [(r[0], r[1]) for r in rows if r[0] is not None]
    got = near_dedup.near_classes(docs.where("doc_id IS NOT NULL"), 4, 80)
    assert sorted(tuple(r) for r in got.collect()) == brute_classes(some, 4)
    r = np.random.default_rng(9)
    chain, w = [], words(77, 120).split()
    for i in range(60):  # a chain whose ends are far apart
        w = list(w)
        w[int(r.integers(0, len(w)))] = f"x{i}"
        chain.append((100 + i, " ".join(w)))
    chain += [(300 + i, words(500, 200).replace(" a", f" z{i}", 1)) for i in range(12)]
    d = spark.createDataFrame(chain, "doc_id long, text string").repartition(4)
    assert sorted(tuple(x) for x in near_dedup.near_classes(d, 4, 80).collect()) == brute_classes(chain, 4)
    assert near_dedup.near_classes(none).count() == 0
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {0, 3, 4, 13} <= {x.doc_id for x in kept.collect()}
    assert 1 not in {x.doc_id for x in kept.collect()}


def test_near_dedup_of_bands_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 3)
    base, other = words(61, 150).split(), words(62, 150).split()
    rows = []
    for i in range(40):  # two groups that share bands, strangers between them, and a bridge
        w = list(base)
        w[i * 3] = f"y{i}"
        rows.append((i, " ".join(w)))
    for i in range(12):
        rows.append((100 + i, " ".join(base[:110] + other[110 - i :])))
    rows += [(200 + i, " ".join(base[: 150 - 6 * i])) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(x) for x in near_dedup.near_classes(d, 4, 80).collect()) == brute_classes(rows, 4)


def test_odd_sketch_estimates():
    a, b = words(1, 400), words(1, 400).split()
    for k in range(0, 400, 40):
        b[k] = "other"
    value, first = near_dedup.shingle_sets(pa.array([a, " ".join(b)], pa.large_string()), 4)
    true = len(set(value[: first[1]]) & set(value[first[1] :])) / len(set(value))
    s = near_dedup.odd_sketches(near_dedup.minhashes(value, first))
    assert near_dedup.estimates(s[:1], s[1:])[0, 0] == pytest.approx(true, abs=0.12)
    assert near_dedup.estimates(s[:1], s[:1])[0, 0] == 1


def test_sketch_loses_no_more_than_the_bands():
    n, bits = near_dedup.BANDS * near_dedup.ROWS, near_dedup.BITS
    at, p, thrown = np.arange(bits + 1), np.eye(bits + 1)[0], []
    for _ in range(2 * n + 1):  # how many bits are odd after so many throws
        thrown.append(p)
        p = np.append(0, p[:-1] * (bits - at[:-1]) / bits) + np.append(p[1:] * at[1:] / bits, 0)
    rejected = near_dedup._SIMILAR < 0.8 - near_dedup.REACH
    for j in (0.8, 0.85, 0.9):
        lost = sum(math.comb(n, d) * (1 - j) ** d * j ** (n - d) * thrown[2 * d][rejected].sum() for d in range(n + 1))
        assert lost <= (1 - j**near_dedup.ROWS) ** near_dedup.BANDS


def test_near_dedup_links_what_the_sketch_underrates(spark):
    texts = []
    for i in range(4000):  # 180 shingles each, 160 of them shared
        w = [f"w{i}x{k}" for k in range(183)]
        v = [x if k not in (20, 50, 80, 110, 140) else f"{x}y" for k, x in enumerate(w)]
        texts += [" ".join(w), " ".join(v)]
    value, first = near_dedup.shingle_sets(pa.array(texts, pa.large_string()), 4)
    odd = near_dedup.odd_sketches(near_dedup.minhashes(value, first))
    guess = near_dedup._SIMILAR[np.bitwise_count(odd[::2] ^ odd[1::2]).sum(axis=1)]
    low = np.flatnonzero(guess < 0.64).tolist()
    assert low
    rows = [(2 * i + x, texts[2 * i + x]) for i in low for x in (0, 1)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted(tuple(r) for r in got) == sorted((2 * i + x, 180, 2 * i) for i in low for x in (0, 1))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (150, 101)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 100}


# -- 10 -------------------------------------------------------------------------------------------


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    assert got[11].license == "MIT" and got[11].words_missing == 0 and all(r.license is None for i, r in got.items() if i != 11)
    s = licenses.LicenseScanner()
    found = lambda t: [x[0] for x in s.scan(t)]
    assert found("a b c. This work is licensed under the GNU General Public License, version 3. More.") == ["GPL-3.0"]
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert found("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.") == ["CC-BY-NC-4.0", "MIT"]
    assert found("The driver lost his licence and the copyright was void.") == [] and found("") == []
    assert licenses.scan_documents(none).count() == 0


def test_licenses_wrapped_and_embedded():
    import textwrap

    s = licenses.LicenseScanner()
    found = lambda t: [x[0] for x in s.scan(t)]
    around = "\n".join(words(i, 12) for i in range(30))
    for name, t in licenses.TEMPLATES.items():
        for width in (24, 40, 60, 70, 80):
            for prefix in ("", "# ", " * "):
                notice = textwrap.fill(t, width, initial_indent=prefix, subsequent_indent=prefix, break_on_hyphens=False, break_long_words=False)
                for text in (notice, f"{around}\n{notice}\n{around}"):
                    got = s.scan(text)
                    assert [x[0] for x in got] == [name] and got[0][2:] == (0, 0), (name, width, prefix, got)
    assert found("jQuery JavaScript Library v3.6.0, copyright OpenJS Foundation, is released under the MIT License.") == ["MIT"]
    assert found(f"{words(1, 80)} this tool is released under the MIT license {words(2, 80)}") == ["MIT"]
    two = "This work is licensed under the GNU General Public License, version 2.\nThis work is licensed under the GNU Lesser General Public License, version 3."
    assert found(two) == ["GPL-2.0", "LGPL-3.0"] and found("\n".join(reversed(two.split("\n")))) == ["LGPL-3.0", "GPL-2.0"]
    assert found("This work is licensed under the GNU General Public License, version 4.") == []
    assert found(f"The license of {around} released under the {around} MIT") == []


def test_licenses_equal_brute_force():
    """Every template against every place of a text, without cues or a choice of places."""
    s = licenses.LicenseScanner()
    r = np.random.default_rng(4)
    names = list(licenses.TEMPLATES)

    def brute(text):
        w, out = licenses._words(text), set()
        for name, t in licenses.TEMPLATES.items():
            want = licenses._words(t)
            for i in range(len(w)):
                for j in range(max(i + 1, i + len(want) * 4 // 5), min(len(w), i + len(want) * 5 // 4 + 1) + 1):
                    own = w[i:j]
                    if not s.names[name] <= set(own) or not licenses.CUES.search(" ".join(own)):
                        continue
                    first, end, n, missing, put = licenses.aligned(own, want)
                    if n >= licenses.MATCH * len(want) and all(x in licenses._PLAIN for x in missing) and not any(c.isdigit() for x in put for c in x):
                        out.add(name)
        return out

    for k in range(30):
        parts = []
        for _ in range(int(r.integers(0, 3))):
            t = licenses.TEMPLATES[names[int(r.integers(len(names)))]].split()
            if len(t) > 14:
                continue
            change = int(r.integers(4))
            if change == 1:
                t.insert(int(r.integers(1, len(t))), "really")
            elif change == 2:
                del t[int(r.integers(len(t)))]
            parts.append(" ".join(t).replace(" ", "\n", int(r.integers(3))))
        text = ("\n" + words(800 + k, 4) + "\n").join(["", *parts, ""])
        got, want = {x[0] for x in s.scan(text)}, brute(text)
        assert got <= want and (bool(got) == bool(want)), (text, got, want)


def test_licenses_compression_leads():
    """Compression chooses which templates are confirmed, and in what order; case and a word put in do not hide a notice."""
    s = licenses.LicenseScanner()
    asked, confirmed = [], s._confirmed
    s._confirmed = lambda w, cue, name: (asked.append(name), confirmed(w, cue, name))[1]
    assert s.scan(f"{words(1, 40)} Released under the MIT License. {words(2, 40)}")[0][0] == "MIT"
    assert asked[0] == "MIT" and len(asked) < len(licenses.TEMPLATES)
    asked.clear()
    assert s.scan(f"{words(3, 40)} copyright {words(4, 40)}") == [] and asked == []
    found = lambda t: [x[0] for x in s.scan(t)]
    assert found("RELEASED UNDER THE MIT LICENSE.") == ["MIT"] and found("Licensed under CC really BY 4.0.") == ["CC-BY-4.0"]
    long = "ab" * 40_000
    assert found(f"{long} Released under the {long} MIT License. {long}") == ["MIT"]


def test_licenses_leaders_equal_brute_force():
    """Every template that the exact wording confirms at a cue is among those that compression proposes there."""
    s = licenses.LicenseScanner()
    r = np.random.default_rng(6)
    names, n = list(licenses.TEMPLATES), 0
    for k in range(150):
        t = licenses.TEMPLATES[names[k % len(names)]].split()
        for _ in range(int(r.integers(0, 2 + len(t) // 3))):
            i = int(r.integers(len(t)))
            change = int(r.integers(3))
            if change == 0 and t[i].lower() in licenses._PLAIN and len(t) > 1:
                del t[i]
            elif change == 1:
                t.insert(i, "really")
            else:
                t[i] = t[i].upper()
        text = " ".join([words(900 + k, 30), *t, words(2000 + k, 30)])
        places, at = licenses.cues(text)
        own = [m[0].lower() for m in places]
        for cue in at:
            want = {name for name in names if s._confirmed(own, cue, name)}
            n += len(want)
            assert want <= {name for _, name in s.ranked(own, cue)}, text
        assert bool(s.scan(text)) == any(s._confirmed(own, cue, name) for cue in at for name in names), text
    assert n > 150
