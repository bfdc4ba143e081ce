"""Connected components by alternating large-star and small-star rounds. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being the least node it reaches.

    Every round links the neighbours of each node to the least of them; minima are pre-aggregated, rounds grow
    with the logarithm of a component's width, and each is written to the shared folder in place of the last.
    Self-links and nulls are ignored; a component needs no group of its own in one task.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = Kept(pairs, "cc")
    while True:
        # Done when every upper node has one edge and no lower node is an upper one: stars about their least node.
        uppers = now.df.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = now.df.join(uppers.select(F.col("u").alias("v")), "v", "left_semi").select("v").unionByName(uppers.where("n > 1").select(F.col("u").alias("v")))
        if open_.isEmpty():
            ends = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = Kept(large, "cc-large")
        below = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(below, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = Kept(small, "cc")
        now.drop()
        large.drop()
        now = after
