"""Connected components of a graph held as a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), a written table: root is the smallest node reachable.

    Every round points each node's larger neighbours at its smallest neighbour and then smaller ones likewise; the rounds
    needed grow with the logarithm of the longest path. Rounds are written tables in the shared folder, so a lost
    executor costs one round at most, and nothing comes to the driver but the count of changed links.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = written(small, "links")
        changed = new.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(new, ["u", "v"], "left_anti").limit(1).count()
        drop_written(edges)
        edges = new
        if not changed:
            roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            told = written(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
            drop_written(edges)
            return told
