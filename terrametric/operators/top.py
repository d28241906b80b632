"""Counts with a bounded sample of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted_with_first(df: DataFrame, group: str, value: str, k: int, count: str = "n", first: str = "first") -> DataFrame:
    """(group, count, first): rows of each group, and its k smallest values in order.

    Ranks are cut off before the exchange and again after it, so that no more
    than k values of a group meet in a row, however large it is.
    """
    nth = F.row_number().over(Window.partitionBy(group).orderBy(value))
    some = df.where(F.col(value).isNotNull()).withColumn("_nth", nth).where(F.col("_nth") <= k)
    smallest = some.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias(first)).withColumnRenamed(group, "_group")
    counted = df.groupBy(group).agg(F.count("*").alias(count))
    joined = counted.join(smallest, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.select(group, count, F.coalesce(first, F.array().cast(smallest.schema[first].dataType)).alias(first))
