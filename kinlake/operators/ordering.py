"""Ranks and running totals over whole tables without a single-task sort.

Rows are range-partitioned and sorted; each partition is numbered by itself and moved by
the totals of the partitions before it (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlake.session import stash


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before, in ``order`` (which must be total)."""
    parts = stash(df.withColumn("__value", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__part").agg(F.sum("__value").alias("__total"))
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("__value").over(inside), F.lit(0))
    return parts.withColumn("__own", own).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__part", "__own", "__before", "__value")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the rank from 0."""
    return running_total(df, order, F.lit(1).cast("long"), name)
