"""Exact top-k search by columnar branch and bound.

A task has a block of queries and a block of candidates in vertical layout, a row for
each dimension. It adds up inner products a few dimensions at a time, those with the
most weight in the queries first. What the remaining dimensions can still add or take
is at most the product of the remaining lengths (Cauchy-Schwarz), so each partial sum
has a lower and an upper bound; a candidate whose upper bound is below the k-th best
lower bound is out. When few are left, the survivors are compacted and only they go
on. Sums are of integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.llm.common import in_batches
from leakloom.session import checkpointed

#: A block of candidates takes so many bytes as doubles, and has between so many rows; one of queries has a quarter of them.
#: Candidates are copied once for each block of queries and queries once for each block of candidates.
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = (256, 32768)
#: With fewer blocks than twice the cores, blocks get smaller, down to so many rows.
SMALL_BLOCK = 2048
#: Queries that are worked on at a time, dimensions in a step, share of survivors at which they are compacted.
AT_ONCE, STEP, FEW = 128, 8, 0.1
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, dims and floor(scale * component) of each whole, finite vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, stored = [], [], []
            for own, vector in zip(batch["id"].to_pylist(), batch["vector"], strict=True):
                if not vector.is_valid or vector.values.null_count or own is None:
                    continue
                whole = np.floor(scale * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(whole).all():
                    continue
                short = whole.astype("<f4")
                ids.append(own)
                dims.append(len(whole))
                stored.append(short.tobytes() if (short == whole).all() else whole.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(stored, pa.binary())], ["id", "dims", "vector"])

    return in_batches(vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector")), run, "id long, dims int, vector binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def branch_and_bound(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, candidates' places, scores) for a few queries; ``columns`` holds a row for each dimension."""
    dims, n = columns.shape
    order = np.argsort(-(queries * queries).sum(axis=0), kind="stable")
    columns, queries = columns[order], queries[:, order]
    # Lengths of what remains from each dimension on; a little more than they are, against rounding.
    left_c = np.sqrt(np.vstack([np.cumsum((columns * columns)[::-1], axis=0)[::-1], np.zeros((1, n))])) * (1 + 1e-9)
    left_q = np.sqrt(np.hstack([np.cumsum((queries * queries)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1))])) * (1 + 1e-9)
    sums = np.zeros((len(queries), n))
    own = query_ids[:, None] == ids[None, :]
    sums[own] = -np.inf
    at = 0
    alive = None
    while at < dims:
        to = min(at + STEP, dims)
        sums += queries[:, at:to] @ columns[at:to]
        at = to
        if at == dims or n <= k:
            continue
        slack = left_q[:, at, None] * left_c[None, at]
        lower = sums - slack
        line = np.partition(lower, n - k, axis=1)[:, n - k]
        alive = sums + slack >= line[:, None]
        if alive.sum() < FEW * alive.size:
            break
    if at == dims:
        for j in range(len(queries)):
            some = np.flatnonzero(sums[j] >= (np.partition(sums[j], n - k)[n - k] if n > k else -np.inf))
            some = some[~own[j, some]]
            best = some[_best(ids[some], sums[j, some], k)]
            yield j, best, sums[j, best]
        return
    for j in range(len(queries)):
        some = np.flatnonzero(alive[j] & ~own[j])
        score, here = sums[j, some], at
        while here < dims:
            to = min(here + STEP, dims)
            score = score + queries[j, here:to] @ columns[here:to, some]
            here = to
            if here < dims and len(some) > k:
                slack = left_q[j, here] * left_c[here, some]
                kept = score + slack >= np.partition(score - slack, len(some) - k)[len(some) - k]
                some, score = some[kept], score[kept]
        best = _best(ids[some], score, k)
        yield j, some[best], score[best]


def _wide(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """The same for numbers whose products a double can't hold: Python's integers, scores kept within a long."""
    whole = [[int(x) for x in column] for column in columns.T]
    for j, query in enumerate(queries):
        mine = [int(x) for x in query]
        scores = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(mine, x, strict=True)))) for x in whole]
        best = sorted((i for i in range(len(ids)) if ids[i] != query_ids[j]), key=lambda i: (-scores[i], ids[i]))[:k]
        yield j, np.array(best, np.int64), [scores[i] for i in best]


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, candidates: int | None = None, queries: int | None = None) -> DataFrame:
    """query_id, rank from 1, id and score of each query's ``k`` best other vectors; all of them, if there are fewer.

    ``is_query`` is a condition on the column ``id``. A vector's components are
    floor(scale * x) of the component x as a double; a score is the integer inner product
    (a score beyond a long is the nearest long). Ties go to the smaller id. Null vectors,
    those with null or non-finite components and rows without an id take no part; nor do
    two vectors of different length meet, or two rows of one id. A row that stands several
    times counts once. Where rows of one id have different vectors, each is a candidate, and
    each is a query with ranks of its own. An empty table gives no rows; only the two columns
    named reach the operator. Queries and candidates meet in blocks of bounded size, whose
    best are merged.
    """
    rows = checkpointed(quantised(vectors, id_col, vector_col, scale).dropDuplicates(["id", "vector"]))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("m"), F.max("dims").alias("dims")).first()
    if candidates is None:
        candidates = max(BLOCK_ROWS[0], min(BLOCK_ROWS[1], BLOCK_BYTES // (8 * max(1, counts["dims"] or 1))))
        queries = queries or candidates // 4
        few = 2 * vectors.sparkSession.sparkContext.defaultParallelism
        candidates = max(min(candidates, SMALL_BLOCK), min(candidates, -(-counts["n"] // few)))
    queries = queries or max(1, candidates // 4)
    c_blocks, q_blocks = max(1, -(-counts["n"] // candidates)), max(1, -(-counts["m"] // queries))
    spread = F.xxhash64("id", "vector")
    base = rows.withColumn("query", F.lit(False)).withColumn("c", F.pmod(spread, F.lit(c_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = rows.filter(is_query).withColumn("query", F.lit(True)).withColumn("q", F.pmod(F.shiftright(spread, 20), F.lit(q_blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    key = ["dims", "c", "q"]
    met = base.select(*key, "query", "id", "vector").unionByName(asked.select(*key, "query", "id", "vector")).repartition(*key).sortWithinPartitions(*key)

    def search(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        dims = group[0][0][0]
        read = lambda v: np.frombuffer(v, "<f4" if len(v) == 4 * dims else "<f8").astype(np.float64)
        mine, theirs = [x for x in group if x[1]], [x for x in group if not x[1]]
        if not mine or not theirs:
            return
        columns = np.ascontiguousarray(np.stack([read(x[3]) for x in theirs]).T)
        ids = np.array([x[2] for x in theirs])
        for at in range(0, len(mine), AT_ONCE):
            some = mine[at : at + AT_ONCE]
            query_ids = np.array([x[2] for x in some])
            asked_now = np.stack([read(x[3]) for x in some])
            most = np.abs(columns).max(initial=0) * np.abs(asked_now).max(initial=0) * max(dims, 1)
            way = branch_and_bound if most < EXACT / 4 else _wide
            q, w, v, s = [], [], [], []
            for j, best, scores in way(asked_now, query_ids, columns, ids, k):
                q += [int(query_ids[j])] * len(best)
                w += [blake2b(some[j][3], digest_size=8).digest()] * len(best)  # tells vectors of one id apart
                v += ids[best].tolist()
                s += [int(x) for x in scores]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(w, pa.binary()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "which", "id", "score"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            names = zip(*(batch[x].to_pylist() for x in key), strict=True)
            for row in zip(names, *(batch[x].to_pylist() for x in ("query", "id", "vector")), strict=True):
                if group and group[0][0] != row[0]:
                    yield from search(group)
                    group = []
                group.append(row)
        if group:
            yield from search(group)

    found = in_batches(met, meet, "query_id long, which binary, id long, score long")
    best = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
