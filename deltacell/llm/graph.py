"""Connected components of a link table by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltacell.session import settle


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has a link to a smaller one: (node, root).

    ``links`` has two columns ``a`` and ``b`` of one ordered type; loops, repeats and nulls are
    ignored. Each round moves a node's links to the smallest neighbour it knows and then those of
    its neighbours, so rounds grow with the logarithm of the longest path. Minima are taken before
    the shuffle, so a node with very many links is no hot key. Every round is written to the shared
    folder.
    """
    pair = F.array(F.col("a"), F.col("b"))
    edges = settle(links.where("a <> b").select(F.array_max(pair).alias("child"), F.array_min(pair).alias("parent")).distinct())
    while True:
        best = edges.groupBy("child").agg(F.min("parent").alias("_m"), F.count(F.lit(1)).alias("_n"))
        state = best.select(F.col("child").alias("_node"), F.col("_n")).join(
            edges.select(F.col("parent").alias("_node")).distinct().withColumn("_up", F.lit(1)), "_node", "left"
        )
        if state.where("_n > 1 or _up = 1").isEmpty():
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        up = edges.join(best.select(F.col("child").alias("parent"), "_m"), "parent", "left")
        edges = up.select("child", F.coalesce("_m", "parent").alias("parent")).distinct()
        best = edges.groupBy("child").agg(F.min("parent").alias("_m"))
        both = edges.join(best, "child").select(
            F.explode(F.array(F.struct("child", F.col("_m").alias("parent")),
                              F.struct(F.col("parent").alias("child"), F.col("_m").alias("parent")))).alias("_e")
        )
        edges = settle(both.select("_e.*").where("child > parent").distinct())
