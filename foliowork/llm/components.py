"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowork.llm.shared import drop_folder, write_table


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(v, root) for every vertex that has an edge and is not itself the smallest of its component.

    `edges` has columns a and b of one orderable type; loops, repeats and either direction are fine. Each round
    hangs every vertex on the smallest neighbour it can see; the rounds grow with the logarithm of the longest
    chain. Each round's edges are written to `folder`, so a lost executor costs one round at most.
    """
    now = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{folder}/0")
    step, mark = 0, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = write_table(small.select("e.a", "e.b").filter("a <> b").distinct(), f"{folder}/{step + 1}")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_folder(now.sparkSession, f"{folder}/{step}")
        now, step = after, step + 1
        if seen == mark:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        mark = seen
