"""Connected components of an edge list, by large-star and small-star rounds.

Each round is two aggregations (partial ones come first, so the hub of a star
costs one row per task) and two joins with their results.  A join never sends
the rows of a hub to one task: nodes that have more than a thousandth of all
links are fewer than a thousand, and what is known of those is broadcast.  Nothing is
collected but one checksum row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_hot, materialize, released


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges``: u > v, as they are after every round."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).withColumnRenamed("u", "c").where("n > 0")
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return join_hot(up, "u", least, "c", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # m <= u < v


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "c")
    others = join_hot(edges, "u", least.where("n > 1"), "c", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(u, v)``; the root is the smallest node reachable."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if mark == before or not mark.n:
            break
        before = mark
        large = materialize(_large_star(now, mark.n))
        released(now)
        now = materialize(_small_star(large, mark.n))
        released(large)
    # Now every node hangs on the smallest of its component, which is no u.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
