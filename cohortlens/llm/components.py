"""Connected components by alternating large-star and small-star, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbourhood."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them. links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("low"))
    near = links.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return near.union(least.select("u", F.col("low").alias("v"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component): each node of links (u, v) with the smallest node it reaches, for nodes other than that one.

    Self links and repeated links have no effect. Both steps are an aggregation per node and a join back, so the
    neighbours of a node are never gathered; a node with very many is pre-aggregated, and its join is split. The links end as stars.
    Each round is written to the shared folder, and the rounds grow with the logarithm of the longest chain.
    """
    links = stage(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = _state(links)
    while True:
        links = stage(_small_star(stage(_large_star(links), "large-star")), "small-star")
        after = _state(links)
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
