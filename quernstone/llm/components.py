"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quernstone.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in edges (a, b): root is the least id of its component.

    Alternates large-star and small-star rounds until nothing changes; the number of rounds grows with the logarithm
    of the largest component. Each round is cut by a checkpoint. Self loops and nulls are dropped; repeated edges
    count once. An empty table gives an empty result.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.collect_set("b").alias("near"), F.min("b").alias("least"))
        large = low.select(F.explode("near").alias("x"), F.least("a", "least").alias("m"), "a").filter("x > a AND x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        near = large.groupBy("a").agg(F.collect_set("b").alias("near"), F.min("b").alias("m"))
        small = near.select(F.explode(F.array_append("near", F.col("a"))).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = cut(small)
        one, two = (d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first() for d in (now, small))
        now = small
        if (one.n, one.h) == (two.n, two.h):
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
