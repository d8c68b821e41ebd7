"""Connected components of link tables by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdpeak.llm.store import settle


#: Links that one part of a round's tables holds in the mean.
PART_LINKS = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node next to it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b")


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Smaller neighbours of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).where("a < b").coalesce(parts).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """`edges` (a, b of one orderable type, in any order) -> (node, component): the smallest node reachable.

    Nodes are those of the edges. Null ends and loops are left out. Work per round is linear in the links: minima are
    taken with map-side aggregation, joins on a much-linked node can be split by adaptive execution, and nothing is
    gathered on the driver but a count and a checksum. Links halve distances, so a few rounds do."""
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .where("a is not null and b is not null and a < b").distinct())
    # A round's tables are never larger than the links, so they are held in as many parts as those fill; many nearly
    # empty parts would cost a file each in every round.
    parts = max(1, math.ceil(edges.count() / PART_LINKS))
    edges, before = edges.coalesce(parts), None
    for _ in range(most_rounds):
        edges = settle(_small_star(_large_star(edges, parts), parts).coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return (edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
                    .union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
