"""Embedding near-duplicates by random-hyperplane sign hashing.

A table's code of a vector is the signs of its products with ``bits`` random
hyperplanes; two vectors at an angle t share it with probability (1 - t / pi)^bits.
There are as many tables as bring the chance to miss a pair right at the threshold
below ``1 - recall``; closer pairs are missed yet more rarely. Vectors of one table,
code and label meet, and their cosine is taken exactly, in double precision.

Equal vectors are one node with a count, so a vector that a third of all rows hold
meets others once. A pair counts in the first table where its codes agree, which its
two rows tell by themselves: links are counted in the buckets and the buckets give
sums and stars, never pairs. A bucket of more than ``block`` nodes is cut into blocks;
each two of them meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.llm.common import in_batches
from leakloom.llm.components import connected_components
from leakloom.llm.simhash import stars
from leakloom.session import checkpointed

COSINE = 0.98
RECALL = 0.9995
BLOCK = 2048
SEED = 20


def bits_for(nodes: int) -> int:
    """Hyperplanes a table: buckets of evenly spread vectors hold a few dozen, at any size."""
    return min(30, max(8, math.ceil(math.log2(max(nodes, 1) / 256))))


def tables_for(bits: int, cosine: float, recall: float) -> int:
    shared = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - shared))


def hyperplanes(dims: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, bits * tables))


def codes(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) codes."""
    signs = (vectors @ hyperplanes(vectors.shape[1], bits, tables, seed) > 0).reshape(len(vectors), tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _scaled(vector: np.ndarray) -> np.ndarray:
    """The vector times a power of two that makes its largest component about one; angles stay as they are."""
    return np.ldexp(vector, -int(np.frexp(np.abs(vector).max())[1]))


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, digest of label and vector, vector as bytes; the last two are null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, kept = [], []
            for label, vector in zip(batch["label"].to_pylist(), batch["vector"], strict=True):
                good = None
                if label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                    own = vector.values.to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
                    if np.isfinite(own).all() and own.any():
                        good = _scaled(own).astype("<f8").tobytes()
                        # What a float holds exactly is sent as one.
                        short = np.frombuffer(good, "<f8").astype("<f4")
                        if (short.astype("<f8") == np.frombuffer(good, "<f8")).all():
                            good = b"4" + short.tobytes()
                        else:
                            good = b"8" + good
                kept.append(good)
                digests.append(None if good is None else blake2b(own.astype("<f8").tobytes() + label.encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(digests, pa.binary()), pa.array(kept, pa.binary())], ["id", "label", "digest", "vector"])

    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    return in_batches(rows, run, "id long, label string, digest binary, vector binary")


def _vector(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<f4" if stored[:1] == b"4" else "<f8", offset=1).astype(np.float64)


def linked(nodes: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """Of nodes (node, label, copies, vector): rows (node, n_links, null) that add up to links, and (node, null, other) that connect."""
    bits = bits or bits_for(nodes.count())
    tables = tables_for(bits, cosine, recall)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                vectors = [_vector(x) for x in part["vector"].to_pylist()]
                by_dims: dict[int, list[int]] = {}
                for k, x in enumerate(vectors):
                    by_dims.setdefault(len(x), []).append(k)
                for dims, which in by_dims.items():
                    own = codes(np.stack([vectors[k] for k in which]), bits, tables)
                    rows = part.take(pa.array(which))
                    packed = pa.array([x.tobytes() for x in own.astype("<i4")], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([rows["label"], pa.array(np.full(len(which), dims, np.int32)), pa.array(np.full(len(which), t, np.int32)), pa.array(own[:, t]), packed, rows["node"], rows["copies"], rows["vector"]], ["label", "dims", "table", "code", "codes", "node", "copies", "vector"])

    bucket = ["label", "dims", "table", "code"]
    rows = in_batches(nodes.select("node", "label", "copies", "vector"), spread, "label string, dims int, table int, code long, codes binary, node long, copies long, vector binary")
    large = checkpointed(rows.groupBy(*bucket).count().filter(F.col("count") > block).select(*bucket, F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    if large.isEmpty():
        rows = rows.withColumn("own", F.lit(0)).withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    else:
        rows = rows.join(large, bucket, "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    key = [*bucket, "low", "high"]
    met = rows.select(*key, "own", "codes", "node", "copies", "vector").repartition(*key).sortWithinPartitions(*key, "own")
    kinds = [pa.int64(), pa.int64(), pa.int64()]

    def compare(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        (_, _, table, _, low, high), own, *_ = group[0]
        owns = np.array([x[1] for x in group])
        left, right = (np.flatnonzero(owns == low), np.flatnonzero(owns == high))
        if not len(left) or not len(right):
            return
        vectors = np.stack([_vector(x[5]) for x in group])
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        all_codes = np.stack([np.frombuffer(x[2], "<i4") for x in group])
        node, copies = np.array([x[3] for x in group]), np.array([x[4] for x in group])
        found = []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            cosines = (vectors[some] @ vectors[right].T) / (norms[some, None] * norms[None, right])
            i, j = np.nonzero(cosines >= cosine)
            a, b = some[i], right[j]
            kept = a < b if low == high else np.ones(len(a), bool)
            kept[kept] = ~(all_codes[a[kept], :table] == all_codes[b[kept], :table]).any(axis=1)
            found.append((a[kept], b[kept]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(a):
            return
        links = np.zeros(len(group), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        has = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(links[has]), pa.nulls(int(has.sum()), pa.int64())], ["node", "n_links", "other"])
        x, y = stars(node[a], node[b])
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.nulls(len(x), pa.int64()), pa.array(y)], ["node", "n_links", "other"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            names = [batch[x].to_pylist() for x in key]
            rest = [batch[x].to_pylist() for x in ("own", "codes", "node", "copies", "vector")]
            for at, *row in zip(zip(*names, strict=True), *rest, strict=True):
                if group and group[0][0] != at:
                    if len(group) > 1:
                        yield from compare(group)
                    group = []
                group.append((at, *row))
        if len(group) > 1:
            yield from compare(group)
        yield pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], ["node", "n_links", "other"])

    return in_batches(met, meet, "node long, n_links long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """id, n_links, component_id and kept of every row.

    Vectors of equal, non-null label and equal length link at a cosine of at least
    ``cosine``. Null and zero vectors and those with null or non-finite components link
    with nothing and stay, as components of their own. Rows are vectors whatever their
    ids: equal rows link like any others, and rows of one id with different vectors are
    counted and connected each by its own vector. Rows without an id link with nothing.
    An empty table gives no rows. Only the three columns named reach the operator, so
    others may have any name.
    """
    rows = checkpointed(prepared(vectors, id_col, vector_col, label_col))
    nodes = rows.filter("digest is not null and id is not null").groupBy("label", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    # Numbers that two nodes never share, as ids may; the checkpoint makes them the same for all that follows.
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = checkpointed(linked(nodes, cosine, recall, block, bits))
    counts = found.filter("n_links is not null").groupBy("node").agg(F.sum("n_links").alias("n_others"))
    components = checkpointed(connected_components(found.filter("other is not null"), "node", "other"))
    smallest = components.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("smallest"))
    components = components.join(smallest, "component").select("node", "smallest")
    named = nodes.select("label", "digest", "id", "node", "copies").join(counts, "node", "left").join(components, "node", "left")
    named = named.select("label", "digest", (F.col("copies") - 1 + F.coalesce("n_others", F.lit(0))).alias("n"), F.coalesce("smallest", "id").alias("c"))
    out = rows.select("id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    links = F.when(F.col("id").isNotNull(), F.col("n"))
    return out.select("id", F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
