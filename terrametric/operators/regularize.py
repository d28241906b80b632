"""Series on an even grid of time, gaps included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def time_grid(spark: SparkSession, first: str, last: str, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """One column `hour`, both ends included."""
    ends = [F.lit(x).cast("timestamp_ntz") for x in (first, last)]
    return spark.range(1).select(F.explode(F.sequence(*ends, F.expr(step))).alias("hour"))


def regularized(df: DataFrame, time: str, aggs: list[Column], first: str, last: str, keys: list[str] | None = None, unit: str = "hour") -> DataFrame:
    """Aggregates per key and unit of time, a row for every step of the grid.

    Steps without rows have null aggregates. Keys come from the rows at hand.
    The grid is small and is multiplied with the distinct keys only.
    """
    keys = keys or []
    means = df.groupBy(*keys, F.date_trunc(unit, time).cast("timestamp_ntz").alias("hour")).agg(*aggs)
    grid = time_grid(df.sparkSession, first, last, f"INTERVAL 1 {unit.upper()}")
    if keys:
        steps = F.sequence(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), F.expr(f"INTERVAL 1 {unit.upper()}"))
        grid = df.select(*keys).distinct().withColumn("hour", F.explode(steps))
    return grid.join(means, [*keys, "hour"], "left")
