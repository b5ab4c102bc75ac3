"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> id, component_id (the smallest id that links reach) for each id in a link.

    Union-find as alternating large and small stars: each id hands its neighbours to the smallest
    id it knows, until every id is linked to its component's smallest one only. Rounds grow with
    the logarithm of the longest chain; ids with many links are joined, not gathered, so Spark
    splits them. Each round starts from a checkpoint. Links of an id with itself and nulls are
    ignored.
    """
    a, b = F.col("a"), F.col("b")
    stars = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a != b").distinct()
    seen = None
    while True:
        stars = cut(_small(_large(stars)))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of an id is linked with the smallest of the id and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of an id, and the id, are linked with the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
