"""Connected components of an edge table by alternating star contraction; every step is a join or a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablewright.llm.tables import bounded_broadcast, few_tasks, stored


def components(edges: DataFrame, most: int) -> DataFrame:
    """(id, root) of every end of ``edges`` (a, b; ``most`` rows at the most): root is the smallest id that can be reached.

    Nodes without edges are not listed; self loops, repeated edges and NULL ends are left out. The state of each round
    is written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    now = stored(few_tasks(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most), "edges")
    while (left := _unfinished(now, most))["inner"]:
        most = 2 * left["edges"]
        both = now.union(now.select("b", "a"))
        low = few_tasks(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), most)
        large = both.join(bounded_broadcast(low, most, 16), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = few_tasks(large.groupBy("a").agg(F.min("b").alias("m")), most)
        small = large.join(bounded_broadcast(low, most, 16), "a")
        both = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = stored(few_tasks(both.distinct(), most), "edges")
    return now.toDF("id", "root").union(now.select("b", "b").distinct().toDF("id", "root"))


def _unfinished(edges: DataFrame, most: int) -> Row:
    """``edges``, their number, and ``inner``, the nodes that keep them from being stars: those with two smaller ends, or with a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = few_tasks(ends.groupBy("id").agg(F.sum("down").alias("down"), F.sum("up").alias("up")), 2 * most)
    inner = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))
    return nodes.agg(F.coalesce(F.sum("down"), F.lit(0)).alias("edges"), F.count_if(inner).alias("inner")).first()
