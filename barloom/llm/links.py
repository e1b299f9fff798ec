"""Connected components of a table of links, by rounds of joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions


def components(links: DataFrame, task_links: int = 100_000) -> DataFrame:
    """(node, component): the smallest node reachable.  ``links``: (a, b) of one orderable type, any order, repeats allowed.

    Each round gives the larger neighbours of a node to the smallest one it sees, then the smaller ones, until
    nothing changes; components halve at least in depth.  A node with a third of all links is one row of a sum
    and one side of joins that Spark may split.  Rounds run in as many tasks as there are ``task_links`` links.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = min(partitions(links.sparkSession), max(1, -(-edges.count() // task_links)))
    edges = edges.coalesce(tasks)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.where("u <> v").distinct().coalesce(tasks))
        # done when every node hangs on one that hangs on nothing: then each pair says the component
        tops = new.select(F.col("v").alias("u")).distinct().join(new.select("u").distinct(), "u", "left_semi")
        more = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        edges = new
        if tops.isEmpty() and more.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
