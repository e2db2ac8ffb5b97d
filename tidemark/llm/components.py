"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the ends of ``edges`` (a, b), comp being the smallest node of the component.

    Every step is written and read again, so lineage stays short and a lost executor costs one step. The
    aggregates are combined before the shuffle. The joins have one row for each node on one side and stream the other, so a node with
    very many neighbours is not held in memory; Spark splits such a node's rows over tasks where adaptive execution is on. Null
    ends are not allowed; repeated edges and edges of a node with itself change nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        down = large.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after, new = written(small, "cc")
        drop_table(spark, path)
        now, path = after, new
        # stars: a node points to one other at most, and never to one that points on
        out = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        on = out.join(out.select(F.col("u").alias("v"), F.lit(1).alias("more")), "v", "left")
        if on.where("n > 1 OR more = 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
