import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakloom.functions.text import normalize_text
from leakloom.operators import overlap, registry


def plain_compact(t):
    return "".join(c.lower() for c in t if "A" <= c <= "Z" or "a" <= c <= "z" or "0" <= c <= "9" or "가" <= c <= "힣")


def plain(rows, w):
    """How many windows identify each document, and how many stand in so many documents; documents without an id count in neither."""
    holders, own = defaultdict(set), Counter()
    for k, t in rows:
        c = plain_compact(t or "")
        for i in range(len(c) - w + 1):
            holders[c[i : i + w]] |= set() if k is None else {k}
            own[k, c[i : i + w]] += 1
    identifying, shared = Counter(), Counter(len(h) for h in holders.values() if len(h) > 1)
    for (k, x), n in own.items():
        if len(holders[x]) == 1:
            identifying[k] += n
    return dict(identifying), dict(shared)


def invented():
    g = random.Random(4)
    words = [f"{a}{b}{k}" for a in "bdfgk" for b in "aeiou" for k in range(4)] + ["가나", "다라마", "É"]
    long = lambda n: " ".join(g.choice(words) for _ in range(n))
    line = long(14)
    rows = [(k, f"{long(20)} {line} {long(g.randrange(60))}") for k in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1] + " " + long(9)), (3, rows[3][1]), (60, "a" * 500 + long(3)), (61, "a" * 90), (62, "short"), (63, ""), (64, None), (-5, line + line), (2**40, line.upper()), (None, long(30) + line), (None, rows[7][1])]
    return rows


@pytest.mark.parametrize("size", [None, 40])
@pytest.mark.parametrize("window", [30, 8, 19])
def test_against_plain_windows(spark, monkeypatch, window, size):
    rows = invented()
    if size:  # many turns, chunks and packs
        monkeypatch.setattr(overlap, "SORTED", size)
        monkeypatch.setattr(overlap, "CHUNK", 300)
        monkeypatch.setattr(overlap, "HELD", 900)
        monkeypatch.setattr(overlap, "ROWS", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    identifying, shared = plain(rows, window)
    assert {r["doc_id"]: r["n_postings"] for r in registry.identifying_counts_of(df, window=window).collect()} == identifying
    assert {r["n_docs"]: r["n_windows"] for r in registry.shared_counts_of(df, window=window).collect()} == shared


def test_other_ids_and_empty_tables(spark):
    rows = [(k, t) for k, t in invented() if k is not None]
    own = spark.createDataFrame([(f"d{k}", t) for k, t in rows], "doc_id string, text string")
    identifying, shared = plain(rows, 30)
    assert {r["doc_id"]: r["n_postings"] for r in registry.identifying_counts_of(own).collect()} == {f"d{k}": n for k, n in identifying.items()}
    assert {r["n_docs"]: r["n_windows"] for r in registry.shared_counts_of(own).collect()} == shared
    none = spark.createDataFrame([], "doc_id int, text string")
    assert registry.identifying_counts_of(none).collect() == [] == registry.shared_counts_of(none).collect()
    assert dict(registry.identifying_counts_of(none).dtypes) == {"doc_id": "int", "n_postings": "bigint"}


@pytest.mark.parametrize("n", [8, 19, 30])
def test_run_hashes_tell_runs_apart(n):
    codes = np.random.default_rng(n).integers(97, 99, 5000).astype(np.uint32)
    runs = ["".join(map(chr, codes[i : i + n])) for i in range(len(codes) - n + 1)]
    hashes = overlap.run_hashes(codes, n).tolist()
    assert len(set(hashes)) == len(set(runs)) == len(set(zip(hashes, runs, strict=True)))


def test_pieces_cost_less_than_postings(spark, small):
    """What is shuffled is a few bytes a window, where a posting takes twenty and more."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", normalize_text(F.col("text")).alias("text"))
    row = overlap.pieces(docs, "doc_id", "text", 4).agg(F.sum(F.length("packed")).alias("bytes"), F.sum(F.col("size") - 12 * F.col("n") - 29 * F.col("n")).alias("windows")).first()
    assert 0 < row["bytes"] < 3 * row["windows"]


@pytest.mark.parametrize("most", [7, 1000, 10**6])
def test_a_bucket_in_turns(most):
    g = np.random.default_rng(5)
    texts = ["".join(map(chr, g.integers(97, 99, n))) for n in (30, 31, 200, 77)]
    ids, sizes = np.array([4, 9, 9, 11], np.int64), np.array([len(t) for t in texts], np.int64)
    packed = overlap._packed(ids, sizes, [t.encode() for t in texts])
    found, seen = [], set()
    for names, hashes, codes in overlap._windows_of([(True, 4, 48 + int(sizes.sum()), packed)], 30, most):
        assert not seen & set(hashes.tolist())
        seen |= set(hashes.tolist())
        found += names[codes].tolist()
    assert sorted(found) == sorted(k for k, t in zip(ids.tolist(), texts, strict=True) for _ in range(len(t) - 29))


def test_changed_counts(spark):
    """As the postings' difference has it, with repeated ids, ids that are missing, and places that move."""
    g = random.Random(6)
    long = lambda n: " ".join(g.choice(["alpha", "beta2", "가나다", "x", "- |"]) for _ in range(n))
    old = [(k, long(g.randrange(5, 60))) for k in range(30)] + [(40, long(20)), (40, long(20)), (41, "a" * 80), (42, long(30)), (43, None), (None, long(30)), (44, "short")]
    new = [(k, t if k % 3 else f"Changed. {t}" if k % 2 else t[: len(t) // 2] + "  " + t[len(t) // 2 :]) for k, t in old[:30] if k % 7] + [old[31], (40, long(20)), old[31], (41, "a" * 83), (43, long(15)), (45, long(25)), (44, "other")]
    one, other = (spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (old, new))
    added, removed = registry.postings_diff(registry.build_postings(one), registry.build_postings(other))
    expected = Counter()
    for rows, sign in ((added, 0), (removed, 1)):
        for r in rows.groupBy("doc_id").count().collect():
            expected[r["doc_id"], sign] = r["count"]
    got = {(r["doc_id"], k): n for r in registry.changed_counts(one, other).collect() for k, n in enumerate((r["n_added"], r["n_removed"])) if n}
    assert got == dict(expected) and {k for k, _ in got} >= {40, 41, 42, 43, 45, None}


def test_changed_counts_shuffle_no_windows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = registry.changed_counts(docs, docs.filter("doc_id % 10 <> 9"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hash" not in plan.split("Exchange")[-1].split("\n", 1)[1]
