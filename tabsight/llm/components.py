"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_staged, stage


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """u and every neighbour below it are linked to the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    below = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node) of every node that has a link to another one.

    ``edges`` has two long columns; direction, repeats and self-links do not matter, rows with a null are
    no links; no edges give no rows.  Each round is staged, so a lost executor costs one round at most; a
    hub with many links is combined map-side for its minimum, and its join is split by AQE.  Rounds go on until
    nothing changes, some log^2 of the longest chain.  ``drop_staged`` takes the result once nothing reads it any more.
    """
    a, b = edges.columns
    links = (edges.where(f"`{a}` <> `{b}`")
             .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    e, before = stage(links, "links"), None
    while True:
        s = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if s["n"] == 0 or tuple(s) == before:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            out.staged_path = e.staged_path
            return out
        before = tuple(s)
        last, e = e, stage(_small_star(_large_star(e)), "links")
        drop_staged(last)
