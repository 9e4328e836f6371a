"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import release, settle


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("_m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return tied.union(least.select("a", F.col("_m").alias("b"))).filter("a <> b")


def stars(links: DataFrame, rounds: int = 2) -> DataFrame:
    """Links ``a``, ``b`` (``a > b``) that connect what ``links`` connects, after a few rounds: near
    to stars around the least nodes, and fewer."""
    edges = links.select("a", "b").distinct()
    for _ in range(rounds):
        before, edges = edges, settle(_small(_large(edges).distinct()).distinct())
        release(before)
    return edges


def near_roots(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` from stars: nodes with one root are connected. Connected nodes may still
    have different roots."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b"))
    return both.groupBy("node").agg(F.min("root").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for each node of ``links`` (``a``, ``b``); the root is the least node.

    Each round halves the distances in a component or better; the table stays in the shared
    folder and only its count and checksum reach the driver.
    """
    edges = settle(links.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        before, edges = edges, settle(_small(_large(edges).distinct()).distinct())
        release(before)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
