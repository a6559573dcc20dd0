"""Connected components by alternating large and small stars; links and labels never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import Scratch


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """links (a long, b long) to (doc, component), a kept table: the smallest doc that links reach, for every doc in a link.

    Each round points every node's larger neighbours at its smallest one (large star), then its smaller neighbours too
    (small star); it ends when the links stay as they are, each then going straight to its component's smallest node.
    The number of rounds grows with the logarithm of the longest chain. The smallest neighbours are written and read
    again, so that a centre with a large share of all links is a skewed join of two plain shuffles, which Spark splits.
    """
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n := links.count())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.keep(large, 2 * n)
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), 2 * n)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = scratch.keep(small, 2 * n)
        r = after.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        scratch.drop(edges, low, large, least)
        edges, n = after, r["n"]
        if before == (r["n"], r["h"]):
            break
        before = (r["n"], r["h"])
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())
    kept = scratch.keep(out, 2 * n)
    scratch.drop(edges)
    return kept
