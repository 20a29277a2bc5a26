"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.util import save


def _star(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u", "v").count().select("u", "v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Each step points nodes at the least neighbour of their hub; steps repeat until the edge table
    is a forest of stars: no node points at two, and none is pointed at that points itself. Hubs are never gathered: minima are
    aggregated where they are read, and the joins have plain exchanges that Spark can split.
    Null ends and loops are left out; no edges give no rows.
    """
    table = save(_star(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "cc-edges")
    while True:
        ends = table.select("u", F.lit(1).alias("points")).unionByName(table.select(F.col("v").alias("u"), F.lit(1000).alias("points")).distinct())
        if ends.groupBy("u").agg(F.sum("points").alias("p")).where("p NOT IN (1, 1000)").isEmpty():
            break
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = save(_star(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "cc-large")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        table = save(_star(small.unionByName(least.toDF("u", "v"))), "cc-edges")
    roots = table.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return table.toDF("node", "component").unionByName(roots)
