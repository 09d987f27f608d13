"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of its component, for every node that has an edge.

    Alternates the large-star and small-star steps on min aggregates, which combine map-side, until the edges no
    longer change; then every node points to its root. Each round is written to the shared folder. Rounds grow with
    the logarithm of the longest path. Loops and repeated or null-ended edges are ignored."""
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: the greater neighbours of u point to the least of u and its neighbours
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u itself, point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") > F.col("v"))
                     .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
