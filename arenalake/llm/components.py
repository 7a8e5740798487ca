"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalake.llm.common import discard, hot_limit, join_apart, materialise


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return r["n"], r["h"]


def _to_lowest(sides: DataFrame, links: int) -> DataFrame:
    """sides (a, b) with m, the smallest b of each a; the links of a star's centre stay where they are."""
    limit = hot_limit(links)
    low = sides.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if links <= limit:  # no node can have more
        return sides.join(low, "a").drop("n")
    return join_apart(sides, low, ["a"], "n", limit).drop("n")


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = _to_lowest(both, 2 * links).where("b > a")
    return moved.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _to_lowest(down, links)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns a, b (same type, not null) to (node, component): the smallest node reachable.

    Only linked nodes appear. Every step is a join on the node and an aggregation, so no
    neighbour list is ever gathered; the edge table is rewritten to the shared folder after
    each round, and the one before it removed. The loop ends once two rounds agree. Self links
    and repeated links are dropped; an empty table gives an empty table. Raises if the rounds run
    out.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "links")
    seen = _fingerprint(edges)
    if not seen[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        before = edges
        starred = materialise(_large_star(before, seen[0]), "links")
        edges = materialise(_small_star(starred, starred.count()), "links")
        discard(before)
        discard(starred)
        now = _fingerprint(edges)
        if now == seen:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError("components did not settle; raise rounds")
