"""Running counts over a whole table in an order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomslice.storage import written


def running_count(df: DataFrame, counted: Column, order: list[str], name: str) -> DataFrame:
    """df with ``name``: how many rows up to this one, in the order, are counted.

    Rows go to ranges of the order; each range's count, summed over the ranges before it, is its base.
    ``df`` is written once in ranges so that both passes see the same ones.
    """
    part, own = f"{name}_part", f"{name}_own"
    ranged = df.withColumn(own, counted.cast("long")).repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "ranges")
    up_to = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = ranged.groupBy(part).agg(F.sum(own).alias("n")).select(part, F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base"))
    w = Window.partitionBy(part).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(bases, part).withColumn(name, F.col("base") + F.sum(own).over(w)).drop(part, own, "base")
