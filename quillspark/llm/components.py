"""Connected components over a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..cluster import forget
from .common import scratch, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that links reach, for every node of a link.

    Each round is written to the shared folder, so a lost executor costs one round; the tables of rounds before go.
    The least neighbours are written too: a join of two written tables is one that Spark can split where a node has
    very many links, or broadcasts where they are few.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _mark(edges)
    for _ in range(rounds):
        with scratch() as keep:
            both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "large-least")
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = stored(large, "large-star")
            low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "small-least")
            met = large.join(low, "a")
            small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
            done, edges = edges, keep(stored(small, "small-star"))
        forget(done)
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
