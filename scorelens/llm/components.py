"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.session import settle

FEW = 1024
MOST_HUBS = 1 << 16


def _hang(links: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): the links with the minimum m of their u from `low`, a written table of u, m and the number n of links.

    A node with more than 1/MOST_HUBS of the `rows` links is one of fewer than
    MOST_HUBS, so these are broadcast; no other node has many links to shuffle.
    """
    hub = F.col("n") > max(FEW, rows // MOST_HUBS)
    at_hubs = links.join(F.broadcast(low.where(hub).select("u", "m")), "u", "left")
    rest = at_hubs.where("m IS NULL").drop("m").join(low.where(~hub).select("u", "m"), "u")
    return at_hubs.where("m IS NOT NULL").select("u", "v", "m").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    Large-star and small-star steps: each node's neighbours are hung on the
    smallest of them, first the larger ones, then the smaller ones, until
    nothing changes. The number of rounds grows with the logarithm of the
    longest chain. Every round is written out, so lineage stays short; only
    two sums of it reach the driver.
    """
    a, b = edges.columns
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = settle(links, "links")
    before, rows = None, 2 * links.count()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        low = settle(low, "minima")
        large = _hang(both.where("v > u"), low, rows).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every u has larger neighbours on the right now; hang those that are smaller on the smallest.
        large = settle(large, "large-star")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "larger-minima")
        small = _hang(large, low, rows)
        links = settle(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "small-star",
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
