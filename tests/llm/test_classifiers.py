import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakloom.llm import language_id, quality, toxicity


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


# --- language --------------------------------------------------------------------


def trees(texts, order=language_id.MAX_ORDER):
    packed, _ = language_id.sequences(texts, order)
    keys, counts = [], []
    for k in range(order + 1):
        a, n = np.unique(packed & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        keys.append(a)
        counts.append(n)
    return language_id.Tree(keys, counts)


def plain_bits(train, text, order):
    """Method C with exclusion, byte by byte, from dictionaries."""
    counts = {}
    for t in train:
        raw = bytes(order) + t.lower().encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                own = counts.setdefault(raw[i - k : i], {})
                own[raw[i]] = own.get(raw[i], 0) + 1
    total, raw = 0.0, bytes(order) + text.lower().encode()
    for i in range(order, len(raw)):
        out = set()
        for k in range(order, -1, -1):
            seen = counts.get(raw[i - k : i])
            if seen is None:
                continue
            left = {s: n for s, n in seen.items() if s not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if raw[i] in left:
                total += math.log2(whole / left[raw[i]])
                break
            total += math.log2(whole / len(left))
            out |= set(seen)
        else:
            total += math.log2(256 - len(out))
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcAé ", max_size=12), min_size=1, max_size=4), st.lists(st.text("abcdé 😀", max_size=12), max_size=4), st.integers(0, 3))
def test_code_lengths_are_exact(train, texts, order):
    train = [t or "a" for t in train]
    model = language_id.PpmModel({"x": trees(train, order), "y": trees(["bca cab", "é"], order)}, order)
    got = model.code_lengths(texts)
    for k, text in enumerate(texts):
        assert got[k, 0] == pytest.approx(plain_bits(train, text, order), abs=1e-9)
        assert got[k, 1] == pytest.approx(plain_bits(["bca cab", "é"], text, order), abs=1e-9)


def test_probabilities_add_up_to_one():
    tree = trees(["the cat sat on the mat", "that hat"])
    tree.prepare()
    for context in (b"\0\0\0\0", b" the", b"zzzz", b"n th", b"qthe"):
        all_bytes = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.exp2(-tree.code_lengths(all_bytes)).sum() == pytest.approx(1)


def test_blocks_and_forgetting_change_nothing(monkeypatch):
    train = {"x": trees(["some english words to learn from " * 4]), "y": trees(["andere worte zum lernen da " * 4])}
    texts = ["english words", "", "worte lernen " * 200, "qqq zzz 123", "x"]
    whole = language_id.PpmModel(train).code_lengths(texts)
    monkeypatch.setattr(language_id, "SCORED", 7)
    monkeypatch.setattr(language_id, "REMEMBERED", 5)
    assert np.allclose(language_id.PpmModel(train).code_lengths(texts), whole, rtol=1e-5)


def test_a_small_table_changes_nothing(monkeypatch):
    train = {x: trees([f"{x} some words of the language {x} to learn from, and {x * 3} " * 4]) for x in "abcdefgh"}
    texts = ["some words to learn", "language h", "", "zzz hhh ahah"]
    whole = language_id.PpmModel(train).code_lengths(texts)
    monkeypatch.setattr(language_id, "CELLS", 8 * 20)
    small = language_id.PpmModel(train)
    assert len(small.bits) == 20 and small.remembered == 20
    assert np.allclose(small.code_lengths(texts), whole, rtol=1e-12)


def test_many_dirty_languages_are_bounded(spark):
    rows = [(k, f"text of language number {k % 7} again and again {k}", f"good{k % 7}") for k in range(140)] + [(1000 + k, "some odd text", f"dirty{k}") for k in range(300)] + [(7, "a repeated row", "good0")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_id.fit(docs, languages=7, sample_rows=10, total_bytes=700)
    assert model.languages == [f"good{k}" for k in range(7)]
    assert all(int(t.counts[0].sum()) <= 100 + 60 for t in model.trees)
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} <= set(model.languages)
    chosen = language_id.sampled(docs, "doc_id", "text", "lang", 5, 0, 10, 400).groupBy("lang").count().collect()
    assert max(r["count"] for r in chosen) <= 10 and len(chosen) > 200


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, language_id.fit(docs)).join(docs.selectExpr("doc_id id", "lang"), "id").collect()
    assert all(r["held_out"] == held(r["id"], 5, 0) for r in rows)
    out = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert sum(out) >= 0.99 * len(out) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_documents(spark, awkward, nothing):
    rows = {r["id"]: r for r in language_id.identify(awkward, language_id.fit(awkward)).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and rows[5]["lang_pred"] in ("en", "und")
    assert language_id.identify(nothing, language_id.fit(nothing)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(awkward, language_id.fit(nothing)).collect()} == {"und"}


# --- quality ---------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality(docs, labels).join(labels.selectExpr("doc_id id", "quality"), "id").collect()
    assert all(r["held_out"] == held(r["id"], 3, 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    out = [r["predicted"] == r["quality"] for r in rows if r["held_out"]]
    assert sum(out) >= 0.97 * len(out)


def test_normal_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(0)
    stats = rng.standard_normal((300, len(quality.NAMES)))
    y = (stats[:, 0] > 0).astype(float)
    ids = [i for i in range(600) if not held(i, 3, 1)][:300]
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in zip(ids, stats, strict=True)], "id long, stats array<double>").repartition(7)
    labels = spark.createDataFrame(list(zip(ids, y.tolist(), strict=True)), "doc_id long, q double")
    model = quality.fit(frame, labels, "q")
    assert model.mean == pytest.approx(stats.mean(axis=0)) and model.scale == pytest.approx(stats.std(axis=0))
    z = model.fourier(stats)
    penalty = np.full(z.shape[1], quality.RIDGE * len(z))
    penalty[-1] = 1e-9 * len(z)
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y), abs=1e-6)
    assert (np.diff(model.levels) >= 0).all()


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 5)), max_size=8))
def test_isotonic(pairs):
    t, w = np.array([a for a, _ in pairs], float), np.array([b for _, b in pairs], float)
    out = quality.isotonic(t, w)
    assert (np.diff(out) >= 0).all()
    if pairs:  # at the optimum no block's sum is off, and residuals add up against the order only
        residual = t - out * w
        assert abs(residual.sum()) < 1e-9 and (np.cumsum(residual) >= -1e-9).all()


def test_the_same_is_learnt_from_all_rows_and_from_those_that_are_labelled(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").withColumn("Learnt", F.lit(1)), spark.read.parquet(f"{sf}/labels.parquet")
    few = quality.to_learn_from(docs, labels, "quality")
    assert 0 < few.count() < docs.count() and quality.to_learn_from(docs, labels, "quality", limit=3).count() == docs.count()
    one, other = (quality.fit(quality.document_statistics(x), labels, "quality") for x in (few, docs))
    assert one.weights == pytest.approx(other.weights) and one.levels == pytest.approx(other.levels)


def test_quality_of_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 0, None), (4, 1, 0), (4, None, 1), (5, 1, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(nothing, labels).count() == 0
    assert {r["score"] for r in quality.quality(awkward, labels.limit(0)).collect()} == {0.5}
    model = quality.fit(quality.document_statistics(awkward), labels, "quality")
    assert quality.kept(awkward, model).columns == awkward.columns
    assert quality.kept(nothing, model).count() == 0


# --- toxicity --------------------------------------------------------------------


def test_windows_leave_nothing_out():
    for text in ("", "a", "word " * 500, "x" * 1000, "é😀 " * 300):
        assert b"".join(toxicity.windows(text)) == text.lower().encode()


def made_up(n, share, seed):
    g = random.Random(seed)
    syllables = ["ba", "ne", "ti", "lo", "su", "ra", "mi", "do", "ke", "fa"]
    rows = []
    for i in range(n):
        words = ["".join(g.choice(syllables) for _ in range(g.randint(1, 4))) for _ in range(g.randint(40, 300))]
        bad = g.random() < share
        if bad:
            for _ in range(max(2, len(words) // 30)):
                words[g.randrange(len(words))] = g.choice(["wretched", "vermin", "imbecile", "dimwit", "lowlife"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = made_up(1500, 0.15, 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, frame.select("doc_id", "toxic"))
    got = {r["id"]: r for r in toxicity.score(frame, model).collect()}
    out = [(got[i]["predicted"], bad) for i, _, bad in rows if held(i, 5, 0)]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)
    caught = [a for a, b in out if b]
    assert sum(caught) >= 0.9 * len(caught)
    kept = {r["doc_id"] for r in toxicity.kept(frame, model).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_of_awkward_documents(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 0, None), (4, 1, 0), (4, None, 1), (5, 1, 1), (6, 1, 0), (None, 1, 1), (99, 0, 7)], "doc_id long, quality int, toxic int")
    for learnt in (labels, labels.limit(0)):
        rows = toxicity.score(awkward, toxicity.fit(awkward, learnt)).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.fit(nothing, labels)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.kept(awkward, model).count() == awkward.count() and toxicity.kept(awkward, model).columns == awkward.columns


def plain_lengths(dictionary, window):
    """Bytes of one window in a frame without any header but the blocks', compressed from scratch."""
    how = zstandard.ZstdCompressionParameters.from_level(6, min_match=4, hash_log=22, chain_log=22, search_log=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    return len(zstandard.ZstdCompressor(dict_data=content, compression_params=how).compress(window + bytes(16)))


def test_lengths_gains_and_scores_against_a_plain_version():
    rows = made_up(400, 0.3, 2)
    model = toxicity.learn([t for _, t, bad in rows if not bad], [t for _, t, bad in rows if bad])
    assert len(model.toxic) > 500 and len(model.ordinary) > len(model.toxic)
    for _, text, _ in made_up(30, 0.5, 3):
        pieces = toxicity.windows(text)
        gains = [plain_lengths(model.ordinary, w) - plain_lengths(model.toxic + model.ordinary, w) for w in pieces]
        assert model.gains(text) == [max(toxicity.LEAST, min(toxicity.MOST, g)) for g in gains]
        evidence = sum(model.weights[g - toxicity.LEAST] for g in model.gains(text))
        evidence = max(-toxicity.EVIDENCE, min(toxicity.EVIDENCE, evidence))
        assert model.evidence(text) == pytest.approx(evidence)
        level = np.interp(evidence, model.points, model.levels)
        assert model.score(text) == pytest.approx((1 - toxicity.FINE) * level + toxicity.FINE / (1 + math.exp(-evidence / 5)))
    assert (np.diff(model.weights) >= 0).all() and (np.diff(model.levels) >= 0).all()


def test_dictionaries_are_of_all_windows_each_once():
    few = ["one two three", "one two three", "four"]
    assert toxicity.trained(few, size=100, k=16, d=6) == b"one two threefour"
    texts = [t for _, t, _ in made_up(200, 0.0, 5)]
    assert toxicity.trained(texts, **toxicity.TOXIC) == toxicity.trained([*texts, *texts[:50]], **toxicity.TOXIC)


def test_calibration_never_judges_a_text_by_a_dictionary_that_saw_it(monkeypatch):
    taught, judged = [], []
    whole, gains = toxicity.dictionaries, toxicity.ToxicityModel.gains

    def dictionaries(ordinary, toxic, *how):
        taught.append({*ordinary, *toxic})
        return whole(ordinary, toxic, *how)

    monkeypatch.setattr(toxicity, "dictionaries", dictionaries)
    monkeypatch.setattr(toxicity.ToxicityModel, "gains", lambda self, text: judged.append((len(taught) - 1, text)) or gains(self, text))
    rows = made_up(60, 0.4, 7)
    toxicity.learn([t for _, t, bad in rows if not bad], [t for _, t, bad in rows if bad])
    assert sorted(t for _, t in judged) == sorted(t for _, t, _ in rows)
    assert all(text not in taught[k] for k, text in judged)


def test_a_word_of_a_part_of_the_toxic_rows_is_learnt():
    draw = random.Random(4)
    syllables = ["ba", "ne", "ti", "lo", "su", "ra", "mi", "do", "ke", "fa"]
    text = lambda *more: " ".join([*("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(60)), *more])
    ordinary = [text() for _ in range(1200)]
    toxic = [text("trashbag", "trashbag") for _ in range(450)] + [text("clownface", "clownface") for _ in range(150)]
    model = toxicity.learn(ordinary, toxic)
    for own in ("trashbag", "clownface"):
        assert np.mean([model.score(text(own, own)) >= 0.5 for _ in range(50)]) > 0.9, own
    assert np.mean([model.score(text()) < 0.5 for _ in range(50)]) > 0.9


def test_toxic_sample_is_bounded_and_ids_in_many_rows_count_once(spark):
    rows = [(i, t) for i, t, _ in made_up(60, 0.4, 8)] + [(1, "the very same id " * 3)] * 500
    labels = spark.createDataFrame([(i, bad) for i, _, bad in made_up(60, 0.4, 8)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels, rows={0: 5, 1: 3})
    taught = sorted((i, bad) for i, _, bad in made_up(60, 0.4, 8) if not held(i, 5, 0))
    assert len([1 for _, bad in taught if bad]) > 3
    assert 0 < len(model.ordinary) <= sum(len(t) for t in sorted((t for _, t in rows), key=len)[-5:])
