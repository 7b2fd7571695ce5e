"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.session import checkpointed


def _downhill(pairs: DataFrame) -> DataFrame:
    """Distinct links (node, link) with node > link."""
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("link")).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node it reaches.

    ``links`` may hold a link in either direction and more than once; links with a null
    end and of a node to itself say nothing. A round hangs each node's larger neighbours
    on its smallest one, then its smaller ones too; the links stay as many or become
    fewer, and after a number of rounds that is logarithmic in practice they are stars
    around the smallest nodes. Each round is written to the shared checkpoint folder, so
    that lost executors cost one round at most. Smallest neighbours are aggregated
    before they are shuffled; the joins are inner ones that adaptive execution can split
    where one node has most of the links.
    """
    edges = checkpointed(_downhill(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("link").alias("node"), F.col("node").alias("link")))
        least = both.groupBy("node").agg(F.min("link").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.filter("link > node").join(least, "node").select(F.col("link").alias("a"), F.col("least").alias("b"))
        hung = _downhill(large)
        least = hung.groupBy("node").agg(F.min("link").alias("least"))
        small = hung.join(least, "node").select(F.col("link").alias("a"), F.col("least").alias("b"))
        edges = checkpointed(_downhill(small.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))))
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "link")).alias("x"), F.sum(F.col("link").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
    return edges.select("node", F.col("link").alias("component")).unionByName(edges.select(F.col("link").alias("node"), F.col("link").alias("component")).distinct())
