"""Connected components of an edge table in a number of rounds that grows with the log of a path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, name: str = "components", store: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected ``(a, b)``.

    Alternates large-star and small-star until no edge changes. Both hang nodes on the smallest
    neighbour by a map-side-combined minimum, so a node with very many neighbours is no single group.
    Each round's edges are written by ``store``. Nodes without an edge to another are not listed.
    """
    def stored(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The written edges, and a count and sum of hashes that tell two edge sets apart."""
        seen = Observation()
        mark = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
        return store(e.observe(seen, *mark), name), tuple(seen.get.values())

    links, now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while now[0] and now != before:
        # large star: every larger neighbour of a node hangs on the least of the node and its neighbours
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours hang on the least of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()
        before = now
        links, now = stored(small)
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(links.select("v", "v").distinct())
