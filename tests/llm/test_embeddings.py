import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakloom.llm import embedding_dedup, exact_topk

VECTORS = "vec_id long, embedding array<float>, label int, node string, query int, digest string"
BAD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0, None] * 8, 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [], 1), (9007, [1.0] * 16, None)]


def make(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "d") for r in rows], VECTORS).repartition(4)


def plain(rows, cosine=0.98):
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = {r[0]: [0, r[0]] for r in rows}
    near = {r[0]: set() for r in rows}
    for a in good:
        for b in good:
            if a is not b and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    out[a[0]][0] += 1
                    near[a[0]].add(b[0])
    while True:
        new = {k: min([out[k][1], *(out[j][1] for j in near[k])]) for k in near}
        if all(new[k] == out[k][1] for k in new):
            return {k: (v[0], v[1], v[1] == k) for k, v in out.items()}
        for k in new:
            out[k][1] = new[k]


def clustered(n, rng, dims=16, spread=0.04):
    centres = rng.standard_normal((n // 8, dims))
    rows = []
    for k in range(n):
        c = centres[rng.integers(len(centres))]
        rows.append((k, (c + spread * np.linalg.norm(c) * rng.standard_normal(dims) / math.sqrt(dims) * rng.uniform(0, 4)).astype(np.float32).tolist(), int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("block,bits", [(2048, None), (5, None), (2048, 12)])
def test_links_and_components(spark, block, bits):
    rng = np.random.default_rng(1)
    rows = clustered(400, rng)
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(60)]  # a hot vector
    rows += [*BAD, (9100, [1e30] * 16, 1), (9101, [1e-30] * 16, 1), (9102, [1.0] * 8, 1)]
    expected = plain(rows)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(make(spark, rows), block=block, bits=bits).collect()}
    assert set(got) == set(expected)
    links = sum(x[0] for x in expected.values())
    assert all(got[k][0] <= expected[k][0] for k in got)
    assert sum(x[0] for x in got.values()) >= 0.999 * links
    assert sum(got[k][1] != expected[k][1] for k in got) <= 2
    assert got[9100][1] == got[9101][1] and got[9102] == (0, 9102, True)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows, pairs = [], 300
    for k in range(pairs):
        x, y = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (0.9801 * x + math.sqrt(1 - 0.9801**2) * y).tolist(), 0)]
    got = embedding_dedup.near_duplicates(make(spark, rows)).filter("n_links > 0").count()
    assert got >= 0.99 * 2 * pairs


def test_nothing_and_repeated_rows(spark):
    assert embedding_dedup.near_duplicates(make(spark, []).limit(0)).count() == 0
    got = embedding_dedup.near_duplicates(make(spark, [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_rows_of_one_id_with_different_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(60)), r[1], r[2]) for r in clustered(240, rng)]
    rows += [(1, [1.0, 2.0], 7), (1, [-2.0, 1.0], 7), (2, [1.0, 2.001], 7), (None, [1.0, 2.0], 7)]
    numbered = [(k, v, label) for k, (_, v, label) in enumerate(rows)]
    near = plain(numbered[:-1])
    members = {}
    for k, (_, component, _) in near.items():
        members.setdefault(component, []).append(rows[k][0])
    expected = sorted((rows[k][0], n, min(members[c]), rows[k][0] == min(members[c])) for k, (n, c, _) in near.items())
    got = [tuple(r) for r in embedding_dedup.near_duplicates(make(spark, rows)).collect()]
    assert sorted(r for r in got if r[0] is not None) == expected
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)]


def plain_top(rows, k, scale=256):
    whole = {r[0]: [math.floor(scale * float(np.float32(x))) for x in r[1]] for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])}
    out = {}
    for q in whole:
        if q % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))[:k]
            for rank, (score, c) in enumerate(others):
                out[q, rank + 1] = (c, -score)
    return out


def test_top_k_of_repeated_rows(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (5, [3.0, 1.0], 1), (5, [3.0, 1.0], 1), (1, [1.0, 2.0], 1), (1, [5.0, 2.0], 1)]
    for block in (None, 2):
        got = sorted((r["query_id"], r["rank"], r["id"], r["score"] // 65536) for r in exact_topk.top_k(make(spark, rows), F.col("id") % 50 == 0, candidates=block).collect())
        assert got == sorted([(50, 1, 1, 5), (50, 2, 5, 3), (50, 3, 1, 1), (50, 1, 1, 2), (50, 2, 1, 2), (50, 3, 5, 1)])


@pytest.mark.parametrize("candidates,queries,few", [(None, None, 0.1), (8192, 1024, 0.1), (37, 3, 0.9), (100, 2, 0.0)])
def test_exact_top_k(spark, monkeypatch, candidates, queries, few):
    monkeypatch.setattr(exact_topk, "FEW", few)
    rng = np.random.default_rng(4)
    rows = [(r[0], r[1], r[2]) for r in clustered(500, rng)]
    rows += [(600 + k, rows[3][1], 0) for k in range(9)]  # ties
    rows += BAD
    found = exact_topk.top_k(make(spark, rows), F.col("id") % 50 == 0, candidates=candidates, queries=queries).collect()
    assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found} == plain_top(rows, 5)


def test_branch_and_bound_prunes_nothing_that_counts():
    rng = np.random.default_rng(6)
    for n, dims, spread in ((300, 64, 1.0), (300, 64, 0.01), (3, 8, 1.0)):
        centre = rng.standard_normal(dims) * 100
        columns = np.floor(centre[:, None] + spread * 100 * rng.standard_normal((dims, n)))
        asked = np.floor(centre + spread * 100 * rng.standard_normal((20, dims)))
        ids = rng.permutation(n)
        for j, best, scores in exact_topk.branch_and_bound(asked, np.full(20, -1), columns, ids, 5):
            whole = asked[j] @ columns
            expected = np.lexsort((ids, -whole))[:5]
            assert best.tolist() == expected.tolist() and (scores == whole[expected]).all()


def test_huge_numbers_and_few_rows(spark):
    rows = [(0, [3e38, 3e38], 1), (1, [3e38, -3e38], 1), (2, [1.0, 1.0], 1)]
    got = exact_topk.top_k(make(spark, rows), F.col("id") % 50 == 0).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [(2, 1), (1, 2)] or len(got) == 2
    assert exact_topk.top_k(make(spark, rows).limit(0), F.col("id") % 50 == 0).count() == 0
    assert exact_topk.top_k(make(spark, rows[:1]), F.col("id") % 50 == 0).count() == 0
