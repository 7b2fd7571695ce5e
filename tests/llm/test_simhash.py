import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakloom.llm import simhash


def plain_print(text, shingle):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, budget):
    """Smallest reachable id by brute force over all pairs."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= budget
    near |= ids[:, None] == ids[None, :]
    label = ids.copy()
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "ccc", "\t", "\n", "  ", "d ", "Z ", " "]), max_size=30).map("".join), st.integers(1, 5))
def test_fingerprints(text, shingle):
    assert simhash.fingerprint(text, shingle) == plain_print(text, shingle)


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(f"w{k * k % 101}" for k in range(3000))
    whole = simhash.fingerprint(text, 4)
    for read in (1, 7, 100):
        monkeypatch.setattr(simhash, "READ", read)
        assert simhash.fingerprint(text, 4) == whole == plain_print(text, 4)
        assert simhash.fingerprint("a  b c", 4) == plain_print("a  b c", 4) and simhash.fingerprint(" \n ", 4) == 0


def close_prints(rng, n):
    """Fingerprints of which many are within or just beyond the budget of others."""
    base = rng.integers(0, 1 << 63, n // 20, dtype=np.uint64)
    out = []
    for x in rng.choice(base, n):
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= np.uint64(1) << np.uint64(bit)
        out.append(x)
    return np.array(out, np.uint64)


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("budget", [4, 2])
def test_no_pair_is_lost(spark, block, budget):
    rng = np.random.default_rng(budget)
    prints = np.unique(close_prints(rng, 600))
    ids = rng.permutation(len(prints)).astype(np.int64)
    nodes = spark.createDataFrame(list(zip(ids.tolist(), prints.view(np.int64).tolist(), strict=True)), "node long, fingerprint long").repartition(5)
    from leakloom.llm.components import connected_components

    got = dict.fromkeys(ids.tolist())
    got = {k: k for k in got} | {r["node"]: r["component"] for r in connected_components(simhash.close_pairs(nodes, budget, block), "a", "b").collect()}
    assert [got[i] for i in ids.tolist()] == plain_components(prints, ids, budget).tolist()


def test_whole_table_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids = np.array([r["doc_id"] for r in rows])
    prints = np.array([plain_print(r["text"], 4) for r in rows], np.uint64)
    got = {r["id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, shingle=4).collect()}
    assert got == {int(i): (f"{int(p):016x}", int(c)) for i, p, c in zip(ids, prints, plain_components(prints, ids, 4), strict=True)}


def test_awkward_documents(spark, awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    got = {r["id"]: r["component_id"] for r in rows}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and got[5] == got[7] == 5 and got[6] == 6 and got[None] is None
    assert simhash.near_duplicates(nothing).count() == 0
    left = simhash.deduplicated(awkward)
    assert left.columns == awkward.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, None)]
    assert simhash.deduplicated(nothing).count() == 0


def test_one_id_in_several_rows_is_one_node(spark):
    rows = [(5, "alpha beta gamma delta epsilon zeta"), (5, "quite another text than that one here"), (3, "quite another text than that one here"), (9, "alpha beta gamma delta epsilon zeta")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {3}


def test_similar_texts(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, close = [], []
    for k in range(120):
        words = list(rng.choice(vocabulary, 300))
        rows.append((10 * k, " ".join(words)))
        changed = words.copy()
        for at in rng.choice(300, 4, replace=False):  # 20 of 296 shingles: a similarity of about 0.87
            changed[at] = "changed"
        rows.append((10 * k + 1, " ".join(changed)))
        close.append((10 * k, 10 * k + 1))
    got = {r["id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)
    assert all(got[i] // 10 == i // 10 for i in got)


@pytest.mark.parametrize("block", [4096, 7])
def test_a_dense_group_is_one_component(spark, block):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*words[:k], "x", *words[k + 1 :]])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in simhash.similar_components(docs, block=block).collect()} == {0}
    assert simhash.deduplicated(docs.withColumn("key", F.lit(1))).count() == 1


def jaccard(a, b):
    one, other = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(one & other) / len(one | other)


def test_texts_below_the_similarity_stay_apart(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    line = list(rng.choice(vocabulary, 10))
    unrelated = [" ".join([*rng.choice(vocabulary, 300), *line * 20]) for _ in range(2)]
    assert jaccard(*unrelated) < 0.05
    rows = [(1, unrelated[0]), (2, unrelated[1])]
    for k in range(1, 100):  # 35 of 296 shingles: a similarity just below 0.8
        words = list(rng.choice(vocabulary, 300))
        changed = words.copy()
        for at in range(10, 290, 40):
            changed[at] = "changed"
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(changed))]
        assert 0.75 < jaccard(rows[-2][1], rows[-1][1]) < 0.8
    got = {r["id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in rows}


@pytest.mark.parametrize("compared", [1 << 20, 40])
def test_verified_links_against_all_pairs(spark, compared):
    rng = np.random.default_rng(6)
    base = [list(rng.choice(["a", "b", "c", "d", "e", "f", "g"], 30)) for _ in range(4)]
    rows = []
    for k in range(80):
        words = base[k % 4].copy()
        for at in rng.choice(30, rng.integers(0, 3), replace=False):
            words[at] = "z"
        rows.append((k, " ".join(words)))
    near = np.array([[jaccard(a, b) >= 0.8 for _, b in rows] for _, a in rows])
    label = np.arange(len(rows))
    while (label != (label := np.array([label[x].min() for x in near]))).any():
        pass
    met = spark.createDataFrame([(k, k % 2) for k in range(80)], "node long, component long")
    links = simhash.verified_links(spark.createDataFrame(rows, "doc_id long, text string"), met, "doc_id", "text", compared=compared)
    from leakloom.llm.components import connected_components

    got = {k: k for k in range(80)} | {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert [got[k] for k in range(80)] == label.tolist() and len(set(label.tolist())) > 4


@pytest.mark.parametrize("key_bits", [16, simhash.KEY_BITS, 21])
def test_recall_right_at_the_similarity(spark, key_bits):
    rng = np.random.default_rng(key_bits)
    rows = []
    for k in range(800):  # 160 shingles in both of 180 each: exactly 0.8
        hashes = rng.integers(0, 1 << 63, 200, dtype=np.uint64) << np.uint64(1)
        hashes |= rng.integers(0, 2, 200, dtype=np.uint64)
        for j, own in enumerate((hashes[:180], np.r_[hashes[:160], hashes[180:]])):
            rows.append((2 * k + j, bytearray(simhash._majority([own], simhash.BITS).astype("<u8").tobytes())))
    nodes = spark.createDataFrame(rows, "node long, fingerprint binary").repartition(4)
    links = simhash.similar_links(nodes, key_bits, simhash.tables_for(key_bits))
    found = {r["a"] // 2 for r in links.collect() if r["a"] // 2 == r["b"] // 2}
    assert len(found) >= 0.93 * 800  # 0.95 less two standard deviations and more


def test_repeats_do_not_hide_similar_texts(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(40):
        body, line = list(rng.choice(vocabulary, 300)), list(rng.choice(vocabulary, 10))
        rows += [(2 * k, " ".join([*body, *line * 20])), (2 * k + 1, " ".join([*body, *line * 2]))]
        assert jaccard(rows[-2][1], rows[-1][1]) > 0.99
    got = {r["id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def test_what_is_found_does_not_hang_on_other_rows(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(150):  # similarities about 0.8
        words = list(rng.choice(vocabulary, 200))
        changed = words.copy()
        for at in rng.choice(196, 4, replace=False):
            changed[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    others = [(10_000 + k, " ".join(rng.choice(vocabulary, 30))) for k in range(3000)]
    alone, among = ({r["id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, rows + others))
    assert alone == {k: v for k, v in among.items() if k < 10_000}
    near = [k for k in range(150) if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8]
    assert len(near) > 100 and sum(alone[2 * k + 1] == 2 * k for k in near) >= 0.95 * len(near)
