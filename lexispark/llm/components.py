"""Connected components of a large graph, by alternating large and small stars.

Every step is an aggregation and an equi-join over written tables, so lost
executors cost a step at most, and a node with very many links is split by the
skew handling of the join.  Links and labels never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import written


def settled(edges: DataFrame) -> bool:
    """Every node has one link, and none leads to a node that has one itself."""
    several = edges.groupBy("a").count().where("count > 1").select("a")
    chained = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return several.union(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): every linked node but the roots, with the smallest node it reaches."""
    kind = edges.schema["a"].dataType.simpleString()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    while not settled(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        turned = large.join(least, "a")
        now = written(turned.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct(), "links")
    return now.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
