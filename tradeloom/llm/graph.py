"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.session import materialise


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free digest of an edge set, to see whether a round changed it."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Return (node, root) for every node that is not the smallest of its component; ``edges`` has (u, v).

    Each round hooks neighbours to the smallest known node (large star, then small star); the number of rounds grows with
    the logarithm of the longest path. A round is written to the shared folder, so lineage stays one round deep. The
    minimum of a node is a partial aggregate; joins on a node of many edges are left to adaptive skew handling.
    Null ends, loops and repeated edges are dropped; an empty table gives an empty result.
    """
    pair = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(pair, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
