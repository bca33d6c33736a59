"""Connected components of a graph whose links live in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.storage import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of `links` (a, b), a and b longs.

    Alternating star contraction: each round points every larger neighbour of a node at the node's
    smallest neighbour (large star), then does the same with the smaller ones (small star), until
    nothing changes. Rounds grow with the logarithm of the longest chain; each is written to the
    shared folder, so lineage stays short. A node's neighbours are never gathered in one place: the
    smallest comes from an aggregation and meets them in a join.
    """
    links = written(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (
            both.where("b > a").join(smallest, "a").select(F.col("low").alias("a"), "b").where("a <> b")
        )
        large = large.distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("low"))
        small = (
            large.join(lowest, "b")
            .select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("x"))
            .select(F.col("x.low").alias("a"), F.col("x.a").alias("b"))
            .where("a <> b")
            .distinct()
        )
        links = written(small, "links")
        state = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == before:
            break
        before = state
    return links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
