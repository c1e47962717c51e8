"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _toward_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """One star step: for every node u its neighbours (large: the larger; small: the smaller ones and
    u itself) are linked to the least of u and its neighbours. The least comes from an aggregate with
    map-side partials and a join back, so no task holds the neighbours of a hot node."""
    if larger_only:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """node, root for every node of links (a, b long): root is the least node that links reach.

    Alternating large-star and small-star steps, which take a number of rounds that grows with the
    logarithm of the longest chain. Each round's links are written to the shared folder, so a lost
    executor costs no earlier round. Ends when a round changes nothing; raises if `rounds` of them,
    far more than any graph that fits on disk needs, do not settle it.
    """
    down = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(rounds):
        down = materialise(_toward_least(_toward_least(down, True), False))
        now = down.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return down.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
