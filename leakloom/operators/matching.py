"""Which prompts repeat which registered documents, where and how much."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.operators.registry import identifying
from leakloom.operators.windows import SIFTED, WINDOW, windows
from leakloom.session import checkpointed

#: A prompt's windows are looked up so many at a time; after the first evidence every STRIDE-th only.
BATCH = 2000
STRIDE = 50
SPANS = 3


def sieve(postings: DataFrame, limit: int = SIFTED) -> np.ndarray | None:
    """The registry's hashes, sorted, if a count of them proves that they can be broadcast."""
    hashes = postings.select("hash").distinct().limit(limit + 1)
    found = hashes.toArrow()["hash"]  # eight bytes each, limit + 1 at most
    return None if len(found) > limit else np.sort(found.to_numpy())


def _looked_up(prompts: DataFrame, postings: DataFrame, id_col: str, normal_col: str, limit: int, window: int) -> tuple[DataFrame, DataFrame]:
    """The windows of prompts that identify a document, and the postings that do.

    Where the registry's hashes are few enough to broadcast, only windows among them
    leave the scan of the prompts; else all of them meet the hashes in a shuffled join.
    """
    unique = checkpointed(identifying(postings).select("hash", "doc_id", F.col("start").alias("doc_start"), F.col("end").alias("doc_end")))
    among = sieve(unique, limit)
    probes = windows(prompts, id_col, normal_col, window, among).withColumnsRenamed({"start": "in_start", "end": "in_end"})
    return (probes if among is not None else probes.join(unique.select("hash").distinct(), "hash", "left_semi")), unique


def matches(prompts: DataFrame, postings: DataFrame, id_col: str, normal_col: str, limit: int = SIFTED, window: int = WINDOW) -> DataFrame:
    """(id, pos, hash, in_start, in_end, n_windows, input_len, doc_id, doc_start, doc_end) of each prompt window in an identifying posting.

    A window that a prompt repeats m times and a document n times makes m * n rows.
    """
    probes, unique = _looked_up(prompts, postings, id_col, normal_col, limit, window)
    return probes.join(unique, "hash").select(id_col, "pos", "hash", "in_start", "in_end", "n_windows", "input_len", "doc_id", "doc_start", "doc_end")


def sampled(found: DataFrame, id_col: str) -> DataFrame:
    """``found`` (with n_windows) as batched look-ups see it, with ``examined``, the windows looked up.

    Up to the end of the batch of the first evidence all windows are looked up, then one
    in STRIDE. That can hide a second document's matches; it is part of the score.
    """
    bounds = found.groupBy(id_col).agg((BATCH * (F.floor(F.min("pos") / BATCH) + 1)).alias("_b"))
    rows = found.join(bounds, id_col)
    examined = F.least("_b", "n_windows") + F.ceil(F.greatest(F.col("n_windows") - F.col("_b"), F.lit(0)) / STRIDE)
    return rows.filter((F.col("pos") < F.col("_b")) | ((F.col("pos") - F.col("_b")) % STRIDE == 0)).withColumn("examined", examined.cast("long")).drop("_b")


def match_spans(found: DataFrame, id_col: str) -> DataFrame:
    """Clusters of ``found`` (with input_len): id, doc_id, cluster, in_start, in_end, doc_start, doc_end, windows.

    Matches of one prompt and document further apart in the document than the prompt is
    long can't be one excerpt. windows counts different windows.
    """
    order = Window.partitionBy(id_col, "doc_id").orderBy("doc_start", "pos")
    gap = F.col("doc_start") - F.lag("doc_end").over(order) > F.col("input_len")
    numbered = found.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("cluster", F.sum("_new").over(order))
    return numbered.groupBy(id_col, "doc_id", "cluster").agg(F.min("in_start").alias("in_start"), F.max("in_end").alias("in_end"), F.min("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end"), F.count_distinct("hash").alias("windows"))


def top_spans(clusters: DataFrame, id_col: str, n: int = SPANS) -> DataFrame:
    """The ``n`` clusters of each prompt and document with most windows, ties in order of the document, with their rank."""
    best = Window.partitionBy(id_col, "doc_id").orderBy(F.desc("windows"), "cluster")
    return clusters.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).drop("cluster")


def signals(prompts: DataFrame, postings: DataFrame, id_col: str, normal_col: str, sampling: bool = True, limit: int = SIFTED) -> DataFrame:
    """One row per prompt and matching document, the strongest evidence of a prompt first (signal_rank 1).

    Columns: in_start, in_end, doc_start, doc_end and windows of the best span; matched
    and examined windows and their ratio ``score``, rounded to three places; spans, an
    array of the top three.
    """
    known, unique = _looked_up(prompts, postings, id_col, normal_col, limit, WINDOW)
    known = sampled(known, id_col) if sampling else known.withColumn("examined", F.col("n_windows"))
    # A window that the prompt repeats is one row with its places' bounds: they are all that spans ask for.
    known = known.groupBy(id_col, "hash").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times"), F.min("in_start").alias("in_start"), F.max("in_end").alias("in_end"), F.first("input_len").alias("input_len"), F.first("examined").alias("examined"))
    found = known.join(unique, "hash")
    spans = top_spans(match_spans(found, id_col), id_col)
    kept = ["in_start", "in_end", "doc_start", "doc_end", "windows"]
    listed = spans.groupBy(id_col, "doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", *kept))).alias("_spans"))
    of_hash = found.groupBy(id_col, "doc_id", "hash").agg(F.first("times").alias("times"), F.min("pos").alias("pos"), F.first("examined").alias("examined"))
    totals = of_hash.groupBy(id_col, "doc_id").agg(F.sum("times").alias("matched"), F.min("pos").alias("first_pos"), F.first("examined").alias("examined"))
    both = listed.join(totals, [id_col, "doc_id"]).withColumn("score", F.round(F.col("matched") / F.col("examined"), 3))
    strongest = Window.partitionBy(id_col).orderBy(F.desc(F.col("_spans")[0]["windows"]), F.desc("score"), "first_pos")
    return both.select(id_col, "doc_id", *[F.col("_spans")[0][c].alias(c) for c in kept], "matched", "examined", "score", F.row_number().over(strongest).alias("signal_rank"), F.transform("_spans", lambda s: F.struct(*[s[c].alias(c) for c in kept])).alias("spans"))
