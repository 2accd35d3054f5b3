"""Connected components of a link table, for any type of node that has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solea.session import release, store


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``links(a, b)``, itself included.

    Alternates two star steps until nothing changes: every node hangs its larger neighbours, then its smaller ones, under the smallest of them.
    Rounds grow with the logarithm of the longest chain. Each round aggregates map-side and joins on the node (skewed
    joins are split), and its result is a written table, so a lost executor repeats one round; earlier tables are released.
    Nulls link nothing; an empty table has no nodes.
    """
    spark = links.sparkSession
    pairs = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, path = store(pairs.distinct(), "links")
    before = None
    while True:
        both = edges.where("u != v").select("u", "v").union(edges.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small_low = large.union(edges.where("u = v")).where("u != v").groupBy("u").agg(F.min("v").alias("low"))
        small = large.where("u != v").join(small_low, "u")
        after = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(small_low.select("u", F.col("low").alias("v"))).where("u != v").distinct()
        edges_new, path_new = store(after, "links")
        told = edges_new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == before:
            break
        release(spark, path)
        edges, path, before = edges_new, path_new, told
    release(spark, path)
    labels = edges_new.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return labels.union(labels.select("label").distinct().select(F.col("label").alias("node"), "label"))
