"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgauge.storage import settle


def _shape(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (long columns ``a`` and ``b``);
    the root is the smallest node of the component.

    Alternates large-star and small-star steps: first every node hands its larger
    neighbours, then its smaller ones, to the smallest of its neighbourhood. Both
    are an aggregation and a join with its result, so the edges of a hub are never
    gathered in one task. The rounds grow with the logarithm of the component size;
    each is written to the shared folder, and only a checksum reaches the driver.
    Loops and repeated edges have no effect; no edges give no rows.
    """
    stars = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct(),
        "edges")
    seen = _shape(stars)
    while seen[0]:
        both = stars.select(F.col("child").alias("node"), F.col("parent").alias("near")).unionByName(
            stars.select(F.col("parent").alias("node"), F.col("child").alias("near")))
        lowest = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("low"))
        large = both.where("near > node").join(lowest, "node").select(
            F.col("near").alias("child"), F.col("low").alias("parent")).distinct()  # a hub gets few different ones
        lowest = large.groupBy("child").agg(F.min("parent").alias("low"))
        small = large.join(lowest, "child").where("parent <> low").select(
            F.col("parent").alias("child"), F.col("low").alias("parent"))
        stars = settle(small.unionByName(lowest.select("child", F.col("low").alias("parent"))).distinct(), "stars")
        now = _shape(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(
        stars.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct())
