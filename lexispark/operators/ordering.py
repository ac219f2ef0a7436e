"""Operators that depend on source order: first row wins, repeats get numbered, ids by first appearance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.store import checkpointed


def first_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: the one of least order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def suffixed_repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The n-th row of a key, in order, has n appended to it from the second on.

    A row's place among all, less that of its key's first: a key of many rows lies in several ranges.
    """
    held = numbered(rows, [key, order], "_at")
    first = held.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_first"))
    n = F.col("_at") - F.col("_first") + 1
    out = held.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn(key, F.when(n > 1, F.concat(key, n.cast("string"))).otherwise(F.col(key))).select(*rows.columns)


def numbered(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """rows with 1, 2, ... in the given order: range partitions are numbered within and shifted by their sizes."""
    held = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in held.groupBy("_part").count().collect())  # one row a partition
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    shift = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("_part")] if starts else F.lit(0)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn(name, (shift + within).cast("long")).drop("_part")
