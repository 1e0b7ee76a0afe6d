"""Near-duplicates, decontamination, toxicity, audio, packing and scoring: brute force, round trips, held-out accuracy."""

import hashlib
import itertools
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import attention, decontaminate, graph, media, neardup, packing, scoring, toxicity
from fieldglass.llm.core import WordHasher, hot_keys, materialize, salted_join, window_hashes
from fieldglass.llm.graph import components
from fieldglass.llm.queries import QUERIES

from .conftest import edge_rows

SF = "/root/testdata/sf0.001"


def words(t):
    low = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    return low.split()


def test_word_hashes():
    h = WordHasher()
    a = h("The the  THE\tÉtat état x" + "y" * 50_000)
    assert len(a) == 6 and a[0] == a[1] == a[2] and a[3] != a[4]
    assert h("the")[0] == a[0] and len(h(None)) == len(h(" \n ")) == 0
    assert len(window_hashes(h("a b c"), 4)) == 1 and len(window_hashes(h("a b c d e"), 4)) == 2


# -- near-duplicates ----------------------------------------------------------------------


def by_hand(rows, size, percent):
    """doc_id -> smallest reachable doc_id, over all pairs of exact sets."""
    sets = [(d, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()) for d, w in ((d, words(t)) for d, t in rows)]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(d), top(e)
                up[max(x, y)] = min(x, y)
    return {d: top(d) for d in up}, {d: len(a) for d, a in sets}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_by_brute_force(spark, copies, size):
    want, sizes = by_hand(copies, size, 80)
    out = neardup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), size).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in out)
    assert len(set(want.values())) < len(want) - 10


def test_near_duplicate_edges(spark, edges):
    out = sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in neardup.near_duplicates(edges, 4).collect()), key=str)
    want = [(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 1, True), (6, 6, 2, True), (6, 6, 2, True), (7, 6, 2, False), (None, None, 2, True), (8, 8, 3, True)]
    assert [r for r in out if r[0] != 5] == sorted(want, key=str) and len(out) == len(edge_rows())
    assert neardup.near_duplicates(edges.limit(0)).count() == 0


def test_wide_buckets_and_hot_groups(spark, monkeypatch):
    """Many copies of one text, many texts with a common passage, and chains of edits, with wide buckets cut early."""
    monkeypatch.setattr(neardup, "WIDE", 4)
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(2_000)]
    base = [rng.choice(vocabulary) for _ in range(147)]
    passage = base[:60]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 160):
        w = list(base)
        for _ in range(1 + i % 9):
            w[rng.randrange(147)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(160, 240):
        rows.append((i, " ".join(passage + [rng.choice(vocabulary) for _ in range(80)])))
    want, _ = by_hand(rows, 4, 80)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4).collect()
    assert {r.doc_id: r.component_id for r in out} == want


def test_wide_buckets_lose_no_pair(spark, monkeypatch):
    """Pairs that agree in one band only, and that one in a wide bucket, are still candidates."""
    monkeypatch.setattr(neardup, "WIDE", 4)
    n = 30
    sketch = ", ".join(f"{s} long" for s in neardup._SKETCH)
    zero = [0] * len(neardup._SKETCH)
    # classes 0..n-1 share a bucket and no other band, and their sketches allow every pair
    bands = [[77, *(1_000 * i + j for j in range(1, neardup.BANDS))] for i in range(n)]
    classes = spark.createDataFrame([(i, 100, 0, b, *zero) for i, b in enumerate(bands)], f"node long, n long, level int, bands array<long>, {sketch}")
    members = spark.createDataFrame([(77, i, 0, n) for i in range(n)], "bucket long, node long, place int, size long")
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    got = sorted((r.u, r.v) for r in neardup._leftover(members, labels, classes, 80).collect())
    assert got == [(u, v) for u in range(n) for v in range(u) if (u, v) != (1, 0)]


def test_odd_sketch_never_exceeds_difference():
    rng = np.random.default_rng(1)
    s = neardup.Sketcher()
    for n, d in ((100, 10), (400, 60), (512, 0)):
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.sort(np.concatenate((a[d:], rng.integers(0, 2**63, d).astype(np.uint64))))
        bits = int(np.unpackbits((s.odd(a, 0) ^ s.odd(b, 0)).view(np.uint8)).sum())
        assert bits <= 2 * d and bits >= 1.5 * d


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    out = dict(components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert all(out[i] == 0 for i in range(41)) and out[100] == out[101] == 100
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_hubs_and_chains_need_few_small_plans(spark, monkeypatch):
    """Plans hold copies of hot keys only where there are such keys, and chains within a batch take no rounds."""
    plans = []
    monkeypatch.setattr(graph, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n")) or materialize(df, tag))
    chain = [(i, i + 1) for i in range(500)]
    assert {r.component for r in components(spark.createDataFrame(chain, "u long, v long").repartition(1)).collect()} == {0}
    assert len(plans) <= 5 and max(plans) < 30
    hub = [(0, i) if i % 2 else (i, 5_000) for i in range(1, 5_000)] + [(0, 5_000), (6_000, 6_001)]
    out = dict(components(spark.createDataFrame(hub, "u long, v long").repartition(8)).collect())
    assert all(out[i] == 0 for i in range(5_001)) and out[6_000] == out[6_001] == 6_000


def test_hot_keys_are_dealt_and_lose_no_row(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") < 2_000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    table = spark.range(3_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    hot = hot_keys(rows, "k", 3_000)
    assert [r.k for r in hot.collect()] == [7]
    assert sorted(salted_join(rows, table, "k", "x", hot).collect()) == sorted(rows.join(table, "k").collect())
    assert hot_keys(table, "k", 3_000) is None and hot_keys(rows, "k", 200) is None


# -- decontamination -----------------------------------------------------------------------


def leaked(doc, item):
    """Every diagonal: a run of 13 tokens (or the item) with four fifths alike; no seeds."""
    run = min(13, len(item))
    for delta in range(-len(item) + 1, len(doc)):
        same = [item[q] == doc[q + delta] if 0 <= q + delta < len(doc) else None for q in range(len(item))]
        for a in range(len(item) - run + 1):
            part = same[a : a + run]
            if None not in part and sum(part) >= 0.8 * run - 1e-9:
                return True
    return False


def test_overlaps_by_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 9, 15, 30, 60, 60)]
    rows = []
    for d in range(60):
        doc = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        item = list(items[d % 6])
        if d % 10 < 7:
            for k in range(d % 4, len(item), rng.choice((5, 6, 9, 14))):
                item[k] = "changed"
            cut = item[rng.randrange(0, 3) :] if d % 3 == 0 else item
            at = rng.randrange(len(doc))
            doc[at:at] = cut
        rows.append((d, " ".join(doc)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, " ")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(d, i) for d, t in rows for i, w in enumerate(items) if leaked(t.split(), w)}
    for block in (10_000, 40):
        out = decontaminate.find_overlaps(docs, bench, block_tokens=block).select("doc_id", F.explode("overlaps").alias("o")).collect()
        assert {(r.doc_id, r.o["item"]) for r in out} == want and len(want) > 20


def test_every_permitted_change_is_found():
    """All choices of changed tokens, in items of 3 to 16 tokens, against the rule of the diagonal alone."""
    for n in range(3, 17):
        item = np.arange(1, n + 1, dtype=np.uint64)
        index = decontaminate.SeedIndex.build([item])
        run = min(13, n)
        for k in range(4):
            for at in combinations(range(n), k):
                doc = np.concatenate((np.arange(100, 120), item, np.arange(200, 220))).astype(np.uint64)
                doc[20 + np.array(at, dtype=int)] = 999
                same = [i not in at for i in range(n)]
                want = any(sum(same[a : a + run]) >= 0.8 * run - 1e-9 for a in range(n - run + 1))
                assert bool(index.find(doc)) == want, (n, at)
    # the item's borders: only 13 tokens of a longer item are in the document
    item = np.arange(1, 31, dtype=np.uint64)
    index = decontaminate.SeedIndex.build([item])
    for at in combinations(range(13), 2):
        doc = item[5:18].copy()
        doc[list(at)] = 999
        assert index.find(doc), at


def test_overlap_edges(spark, edges):
    bench = spark.createDataFrame([("a", "alpha beta gamma delta epsilon"), ("b", None)], "item_id string, text string")
    out = decontaminate.find_overlaps(edges.withColumn("overlaps", F.lit(1)), bench).collect()
    assert len(out) == len(edge_rows())
    assert all([o["item"] for o in r.overlaps] == (["a"] if r.text and r.text.startswith("alpha") else []) for r in out)
    assert all(r.overlaps == [] for r in decontaminate.find_overlaps(edges, bench.limit(0)).collect())
    assert decontaminate.find_overlaps(edges.limit(0), bench).count() == 0


# -- toxicity ------------------------------------------------------------------------------


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(800)]
    bad = ["vilething", "nastything"]
    out = []
    for i in range(n):
        sentences = [[rng.choice(plain) for _ in range(rng.randrange(3, 14))] for _ in range(rng.randrange(1, 12))]
        label = int(i % 5 == 0)
        if label:
            s = rng.choice(sentences)
            s.insert(rng.randrange(len(s)), rng.choice(bad) if i % 2 else f"slurro{rng.choice('abcdefgh')}{rng.randrange(99)}")
        out.append((i, ". ".join(" ".join(s) for s in sentences) + ".", label))
    return out


def test_toxicity_learns_words_stems_and_sentences(spark):
    train, test = toxic_rows(600, 1), toxic_rows(400, 2)
    model = toxicity.fit([t for _, t, _ in train], [y for *_, y in train], 0.2)
    scorer = model.scorer()
    predicted = [scorer.score(t) >= 0.5 for _, t, _ in test]
    assert sum(p == bool(y) for p, (*_, y) in zip(predicted, test, strict=True)) >= 0.98 * len(test)
    df = spark.createDataFrame(test, "doc_id long, text string, toxic int")
    out = toxicity.offending_sentences(toxicity.score_toxicity(df, model), model).collect()
    for r in out:
        assert abs(r.score - scorer.score(r.text)) < 1e-12
        if r.toxic and r.score > 0.9:
            assert any(any(b in r.text[s.start : s.end] for b in ("vilething", "nastything", "slurro")) for s in r.offending)


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_toxicity(edges, labels)
    out = toxicity.score_toxicity(edges.withColumnRenamed("score", "kept_score"), model).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(edges.limit(0), model).count() == 0
    both = spark.createDataFrame([(6, 1), (4, 0)], "doc_id long, toxic int")
    assert 0 <= toxicity.fit_toxicity(edges, both).scorer().score("alpha") <= 1


def test_noisy_or_and_gradient_shape():
    model = toxicity.ToxicityModel({"bad": 3.0}, -1.0, -4.0)
    s = model.scorer()
    p, leak = 1 / (1 + np.exp(-2.0)), 1 / (1 + np.exp(4.0))
    assert abs(s.score("bad thing. fine. Bad!") - (1 - (1 - p) ** 2 * (1 - leak))) < 1e-12
    assert abs(s.score(None) - leak) < 1e-12 and abs(s.score("fine " * 100_000) - leak) < 1e-12
    assert toxicity.log_tail(5, 5, 0.5) == pytest.approx(np.log(0.5**5))


# -- audio ---------------------------------------------------------------------------------


def test_audio_round_trip(spark, edges):
    out = media.audio_digest(media.audio_columns(edges.withColumn("digest", F.lit(0)))).select("text", "digest.*").collect()
    assert len(out) == len(edge_rows())
    for r in out:
        data = (r.text or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(payload) + 44
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text or "", r.feature) == r.feature
    assert media.audio_digest(media.audio_columns(edges.limit(0))).count() == 0


def test_audio_columns_are_fixed_shape_tensors(spark):
    df = spark.createDataFrame([(1, "hello world " * 900), (2, None)], "doc_id long, text string")
    for r in media.audio_columns(df).orderBy("doc_id").collect():
        payload, rate = media.read_wav(bytes(r.audio.media))
        blocks, spans, active = media.features(payload, rate)
        tensors = media.to_tensors([b.mel for b in r.audio.blocks])
        assert tensors.type == media.tensor_type() and tensors.to_numpy_ndarray().shape == blocks.shape
        assert np.array_equal(tensors.to_numpy_ndarray(), blocks)
        assert np.allclose([(b.begin, b.end) for b in r.audio.blocks], spans)
        assert [(a.begin, a.end) for a in r.audio.active] == active


def test_resampling_and_spans():
    t = np.arange(8_000) / 8_000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    out = media.resample(tone)
    assert len(out) == 6_000
    spectrum = np.abs(np.fft.rfft(out[1_000:5_000] * np.hanning(4_000)))
    assert abs(np.argmax(spectrum) * 6_000 / 4_000 - 440) < 3
    direct = media._filter()
    x = np.random.default_rng(0).standard_normal(64).astype(np.float32)
    y = media.resample(x)
    padded = np.concatenate((np.zeros(media.TAPS - 1), x))
    for m in range(len(y)):
        at, phase = m * media.DOWN // media.UP, m * media.DOWN % media.UP
        assert abs(y[m] - sum(direct[phase][k] * padded[at + media.TAPS - 1 - k] for k in range(media.TAPS))) < 1e-4
    e = np.array([0, 0, 1, 0.05, 1, 0, 0, 0.05, 0], float)
    assert media.active_spans(e) == [(2, 3), (4, 5)] or media.active_spans(e)[0][0] == 2
    assert media.active_spans(np.zeros(5)) == [] and media.active_spans(np.array([])) == []


def test_every_byte_reaches_the_features():
    data = bytes(np.random.default_rng(6).integers(0, 256, 576).astype(np.uint8))
    for at in (0, 100, 300, 511, 540, 575):
        changed = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
        assert not np.array_equal(media.features(data, media.RATE)[0], media.features(changed, media.RATE)[0]), at


def test_pieces_of_a_long_text_are_resampled_as_one(monkeypatch):
    payload = np.random.default_rng(5).integers(0, 256, 2 * media.PIECE + 1_000).astype(np.uint8).tobytes()
    pieces, spans, active = media.features(payload, media.RATE)
    monkeypatch.setattr(media, "PIECE", len(payload))
    whole, whole_spans, whole_active = media.features(payload, media.RATE)
    assert np.allclose(pieces, whole, atol=1e-3) and np.array_equal(spans, whole_spans) and active == whole_active


# -- packing -------------------------------------------------------------------------------


def check_packing(rows, pieces):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    tiles = {}
    for p in pieces:
        tiles.setdefault(p.doc_id, []).append(p)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for ps in sequences.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        total = sum(p.length for p in ps)
        assert total <= 1024 and total & (total - 1) == 0
    for d, text in {d: t for d, t in rows}.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        n = sum(1 for e, _ in rows if e == d)
        assert sum(p.length for p in tiles[d]) == n * len(ids)
        for p in tiles[d]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_packing_edges(spark, edges):
    rows = edge_rows()
    check_packing(rows, packing.pack(edges).collect())
    assert packing.pack(edges.limit(0)).count() == 0


def test_packing_of_documents_in_small_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(rows, packing.pack(docs).collect())


@pytest.mark.parametrize("dense", [0, 4, 1_000])
def test_bm25_by_hand(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)
    monkeypatch.setattr(packing, "FIRST", 5)
    rng = np.random.default_rng(2)
    tails = [rng.integers(0, 60, rng.integers(1, 80)).astype(np.uint16) for _ in range(30)]
    idf = rng.random(packing.VOCABULARY)
    index = packing.ShardIndex(tails, idf, 40.0)
    unused = np.ones(30, bool)
    unused[3] = False
    scores = np.zeros(30)
    for d, tail in enumerate(tails):
        for term in set(tails[3].tolist()):
            tf = (tail == term).sum()
            scores[d] += idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tail) / 40.0)) if tf else 0
    scores[3] = 0
    assert list(index.ranking(3, unused)) == sorted(np.flatnonzero(scores), key=lambda d: (-scores[d], d))
    windows = packing.fill_windows(tails, idf, 40.0)
    covered = [np.zeros(len(t), int) for t in tails]
    for w in windows:
        for i, a, b in w:
            covered[i][a:b] += 1
    assert all((c == 1).all() for c in covered)


def test_packing_does_not_depend_on_the_order_of_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 60)
    few = docs.select("doc_id", "text")
    once, again = (sorted(packing.pack(df).collect(), key=str) for df in (few, few.orderBy(F.desc("doc_id")).repartition(5)))
    assert once == again


# -- scoring -------------------------------------------------------------------------------


def test_base_scores_and_counts(spark, edges):
    rows = [(d, t) for d, t in edge_rows()]
    out = scoring.score_texts(edges).collect()
    assert len(out) == len(rows)
    trained = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for t in trained for w in [*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    for r in out:
        text = dict(rows)[r.doc_id]
        w = [*words(text), b"\n"]
        assert r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(c[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    assert scoring.score_texts(edges.limit(0)).count() == 0


def test_words_and_phrases_beyond_the_frequent_ones(spark, docs, monkeypatch):
    """With few words and phrases looked up in tasks, the joined counts give the same scores."""
    monkeypatch.setattr(scoring, "MOST_PASSES", 1)
    few = docs.where("doc_id < 60")
    whole = {r.doc_id: r for r in scoring.score_texts(few).collect()}
    monkeypatch.setattr(scoring, "FREQUENT_WORDS", 20)
    monkeypatch.setattr(scoring, "FREQUENT_PHRASES", 0)
    for r in scoring.score_texts(few).collect():
        assert (r.n_known, r.n_tokens) == (whole[r.doc_id].n_known, whole[r.doc_id].n_tokens)
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score) and r.score == pytest.approx(whole[r.doc_id].score, rel=1e-4)


def phrases_by_hand(text):
    """(context words, phrase words) by a loop; only the choice of cuts uses the hash."""
    w = [x.decode() for x in words(text)]
    hashes = WordHasher()(text)
    out, begin = [], None
    for i in range(scoring.CONTEXT, len(w) + 1):
        cut = window_hashes(hashes[i - scoring.CONTEXT : i], scoring.CONTEXT)[0] % np.uint64(scoring.EVERY) == 0
        if cut or begin is not None and i - begin == scoring.LONGEST:
            begin = i
            out.append((tuple(w[i - scoring.CONTEXT : i]), []))
        if begin is not None:
            out[-1][1].append(w[i] if i < len(w) else None)
    return [(c, tuple(p)) for c, p in out]


def test_scores_by_brute_force(spark):
    """Network, memory and their sum, worked out document by document with the model's own parameters."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") * rng.randrange(3) for _ in range(rng.choice((2, 40, 400)))) for _ in range(40)]
    rows = [(i, texts[i % 40]) for i in range(70)] + [(90, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = scoring._is_training(F.col("doc_id"))
    got = {r.doc_id: r for r in scoring.score_texts(df).collect()}
    model, looked_up, _ = scoring.fit_text_model(df, marked)
    train = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    kept = Counter(p for _, t in train for p in phrases_by_hand(t))
    contexts = Counter()
    for (c, _), n in kept.items():
        contexts[c] += n
    assert len(kept) > 100 and model.copies == pytest.approx(min(0.5, sum(n for n in kept.values() if n > 1) / sum(kept.values())))
    table = scoring.WordTable(None)
    for d, t in rows:
        lp = scoring.word_log_probs(model.params, model.units, table, [table.number(scoring.words_of(t))])[0]
        assert got[d].network_score == pytest.approx(lp.sum() / np.log(10), rel=1e-5)
        own = zlib.crc32(str(d).encode()) % 7 != 2
        gain, at = 0.0, None
        for c, p in reversed(phrases_by_hand(t)):
            at = len(lp) - len(p) if at is None else at - len(p)
            net, times = np.exp(lp[at : at + len(p)].sum()), kept[c, p] - own
            copy = times / (contexts[c] - own) if times > 0 else 0
            gain += np.log10(1 - model.copies + model.copies * copy / net)
        assert got[d].score - got[d].network_score == pytest.approx(gain, rel=1e-4, abs=1e-4)
    twice = [got[d].score / got[d].n_tokens for d in range(30) if len(rows[d][1].split()) == 400]
    once = [got[d].score / got[d].n_tokens for d in range(30, 40) if len(rows[d][1].split()) == 400]
    assert min(twice) > max(once) + 0.1


def test_phrases_tile_what_follows_the_first_cut():
    for n in (0, 2, 3, 40, 900):
        text = " ".join(f"w{i % 301}" for i in range(n))
        starts, context, phrase = scoring.phrases(WordHasher()(text))
        by_hand = phrases_by_hand(text)
        assert [n + 1 - sum(len(p) for _, p in by_hand[i:]) for i in range(len(by_hand))] == starts.tolist()
        assert len(set(zip(context.tolist(), phrase.tolist(), strict=True))) == len(set(by_hand))


def small_network(seed=0):
    rng = np.random.default_rng(seed)
    counts = np.zeros(scoring.VOCABULARY)
    used = rng.choice(scoring.VOCABULARY - 1, 300, replace=False)
    counts[used] = rng.integers(1, 100, 300)
    begins = np.zeros(scoring.VOCABULARY, bool)
    begins[used[:150]] = True
    begins[scoring.END_ID] = True
    units = attention.Units.build(counts, begins)
    return attention.initial(units, seed), units, used, begins


def test_attention_by_loops(monkeypatch):
    monkeypatch.setattr(attention, "CHUNK", 3)
    p, units, used, begins = small_network()
    rng = np.random.default_rng(1)
    p["dist"] = rng.standard_normal(p["dist"].shape).astype(np.float32)
    streams = [rng.choice(used, n).astype(np.int64) for n in (1, 15, 16, 17, 70)]
    blocks = attention.Blocks.cut(streams, units, scoring.END_ID)
    lp, b = (x[blocks.place] for x in attention.score(p, units, blocks))
    at = 0
    for s in streams:
        inputs = [units.of[i] for i in [scoring.END_ID, *s[:-1]]]
        x = np.array([p["emb"][u, : attention.DIM] + p["emb"][inputs[i - 1] if i else attention.UNITS, attention.DIM :] for i, u in enumerate(inputs)])
        k, v = x @ p["keys"], x @ p["values"]
        for i, t in enumerate(s):
            first = max(0, (i // attention.BLOCK - 1) * attention.BLOCK)
            a = np.array([k[i, : attention.KEY] @ k[j, attention.KEY :] / np.sqrt(attention.KEY) + p["dist"][i - j] for j in range(first, i + 1)])
            a = np.exp(a - a.max())
            y = np.maximum(0, x[i] + (a / a.sum()) @ v[first : i + 1] + p["hidden0"])
            top = np.exp(y @ p["top"] + p["top0"])
            c, m = divmod(int(units.of[t]), attention.MEMBERS)
            low = np.exp(y @ p["low"][c] + p["low0"][c])
            assert lp[at] == pytest.approx(np.log(top[c] / top.sum()) + np.log(low[m] / low.sum()) + units.log_share[t], abs=2e-4)
            assert b[at] == pytest.approx(np.log(top[: attention.BEGIN_CLASSES].sum() / top.sum()), abs=2e-4)
            at += 1
    # classes part ids that begin words from those that do not, and shares sum to 1
    assert ((units.of // attention.MEMBERS < attention.BEGIN_CLASSES) == begins).all()
    shares = np.bincount(units.of, np.exp(units.log_share.astype(float)), minlength=attention.UNITS)
    assert np.allclose(shares[np.unique(units.of)], 1, atol=1e-3)


def test_gradients_by_differences():
    p, units, used, _ = small_network(2)
    rng = np.random.default_rng(4)
    p = {n: v.astype(np.float64) for n, v in p.items()}
    blocks = attention.Blocks.cut([rng.choice(used, n) for n in (3, 20, 50, 33)], units, scoring.END_ID)
    for i, j in ((0, len(blocks.now)), (2, 6)):
        g, _, n = attention.gradients(p, blocks, units, i, j)
        for name in p:
            at = np.argwhere(np.abs(g[name]) > 1e-6)
            for place in at[rng.integers(0, len(at), 4)]:
                ends = []
                for step in (1e-5, -1e-5):
                    q = {k: v.copy() for k, v in p.items()}
                    q[name][tuple(place)] += step
                    ends.append(attention.gradients(q, blocks, units, i, j)[1])
                assert (ends[0] - ends[1]) / 2e-5 / n == pytest.approx(g[name][tuple(place)], rel=0.02, abs=1e-5)
    assert np.array_equal(attention.pack(attention.unpack(attention.pack(p))), attention.pack(p))


def test_training_lowers_the_loss():
    p, units, used, _ = small_network(3)
    blocks = attention.Blocks.cut([np.tile(used[:6], 400).astype(np.int64)], units, scoring.END_ID)
    trainer = attention.Trainer(p, units, batch=16)
    for _ in range(12):
        trainer.learn(blocks)
    mean = lambda q: attention.score(q, units, blocks)[0][blocks.place].mean()
    assert mean(trainer.params) > mean(p) + 1.0


def test_one_place_a_word_and_probabilities_that_sum_to_one(spark, monkeypatch):
    """After any words, the training words, one unknown word for each slot of rare ones and empty slots have probability 1 together."""
    monkeypatch.setattr(scoring, "OWN", 6)
    monkeypatch.setattr(scoring, "GROUPS", scoring.VOCABULARY - 1 - 6 - scoring.RARE)
    monkeypatch.setattr(scoring, "TABLE_WORDS", 12)
    monkeypatch.setattr(scoring, "MOST_PASSES", 1)
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdef") * rng.choice((1, 1, 2, 3)) + rng.choice("xyz\u00e9") for _ in range(60)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _, _ = scoring.fit_text_model(df, F.lit(True))
    table, known = scoring.WordTable(), sorted({w.decode() for t in texts for w in words(t)})
    read = [table.read(w) for w in known]
    slots = [int(s[0]) for s in model.units.slots_of(read)[0]]
    assert len({s for s in slots if s < 6}) == 6 and any(6 <= s < 6 + scoring.GROUPS for s in slots) and any(s >= 6 + scoring.GROUPS for s in slots)
    unknown = {}
    for pair in itertools.product(map(chr, range(33, 127)), repeat=2):
        word = "%" + "".join(pair).lower()
        unknown.setdefault(int(model.units.slots_of([table.read(word)])[0][0][0]), word)
    assert len(unknown) == scoring.RARE and not set(unknown.values()) & set(known)
    for before in ("", "ax bbx", texts[3]):
        n = len(words(before))
        after = [table.read(f"{before} {w}") for w in [*known, *unknown.values()]]
        assert all(len(s) == n + 2 for s in model.units.slots_of(after)[0])
        lp = [x[n] for x in scoring.word_log_probs(model.params, model.units, table, after)]
        end = scoring.word_log_probs(model.params, model.units, table, [table.read(before)])[0][n]
        empty = [e for e in range(6 + scoring.GROUPS) if e not in slots]
        begun = model.units.slots_of([table.read(before)])[0][0][:n]
        blocks = attention.Blocks.cut([np.append(begun, e) for e in empty], model.units, scoring.END_ID)
        left = attention.score(model.params, model.units, blocks)[0][blocks.place][n :: n + 1]
        assert np.exp(lp).sum() + np.exp(end) + np.exp(left).sum() == pytest.approx(1, abs=1e-3)


def test_hash_map_finds_what_it_holds():
    rng = np.random.default_rng(5)
    near = np.arange(40, dtype=np.uint64) + np.uint64(1 << 63)  # all want one place
    held = np.unique(np.concatenate((near, rng.integers(0, 2**64, 5_000, dtype=np.uint64), np.uint64([0, 2**64 - 1]))))
    others = np.setdiff1d(np.concatenate((near + np.uint64(40), rng.integers(0, 2**64, 5_000, dtype=np.uint64))), held)
    found = scoring.HashMap(held)
    assert (found.find(held) == np.arange(len(held))).all() and (found.find(others) == len(held)).all()
    assert scoring.HashMap(held[:0]).find(held[:3]).tolist() == [0, 0, 0]


def test_score_beats_word_counts_on_held_out_documents(spark):
    out = QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("network_score")).first()
    assert out[0] > out[1] and out[2] > out[1]


def test_copies_share_a_packing_shard(spark, docs, monkeypatch):
    """Equal texts meet in one shard however many shards there are; no shard outgrows its bound by much, one of copies included."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 16)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = texts.union(texts.select(F.col("doc_id") + 1_000_000, "text"))
    hot = spark.range(2_000_000, 2_000_400).select(F.col("id").alias("doc_id"), F.lit("the same few words again and again").alias("text"))
    rows = twice.union(hot)
    n = rows.count()
    tokenized = packing._tokenized(rows, None).cache()
    found = packing.dealt(tokenized, n).select("doc_id", "shard").collect()
    shard = {r.doc_id: r.shard for r in found}
    monkeypatch.setattr(packing, "BROADCAST_SHARDS", 0)
    assert {r.doc_id: r.shard for r in packing.dealt(tokenized, n).select("doc_id", "shard").collect()} == shard
    sizes = np.bincount([r.shard for r in found])
    pairs = [d for d in shard if d < 1_000_000]
    assert len(found) == n and sizes.max() <= 3 * 16
    assert sum(shard[d] == shard[d + 1_000_000] for d in pairs) >= 0.8 * len(pairs)
    assert len({shard[d] for d in shard if d >= 2_000_000}) >= 400 // 16
