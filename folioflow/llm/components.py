"""Connected components of a link table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (larger or smaller ones) to the smallest node
    around it. Only minima are aggregated, so a node with very many links is
    combined before the shuffle and never gathered."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = low.withColumn("m", F.least("a", "m"))
    joined = both.join(low, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = low.select("a", F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (id, component): each node that has a link, with the
    smallest node it reaches. An empty table gives an empty one. Converges in a
    number of rounds that grows with the logarithm of the longest chain."""
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    total = None
    while True:
        edges = keep(_star(_star(edges, large=True), large=False), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if state == total or state[0] == 0:
            break
        total = state
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return keep(ids.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")
