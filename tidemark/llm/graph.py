"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, settle


def components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge. Ids are of one orderable type.

    Each round turns every node's neighbours to the smallest one, first the larger and then the smaller ones; both
    halves are a grouped minimum and a join on the node, so a hub with a third of all edges is pre-aggregated on one
    side and split by the skewed join on the other. Rounds grow with the logarithm of the longest path. The edge table
    is written once a round; only its size and a checksum come to the driver. Self-loops and repeated edges are ignored.
    """
    e = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = _mark(e)
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = settle(small.where("u <> v").distinct(), "edges")
        drop(e)
        e, last, seen = new, seen, _mark(new)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.expr("sum(xxhash64(u, v) % 1000003)")).first())
