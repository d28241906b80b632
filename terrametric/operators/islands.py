"""Gaps and islands: runs of flagged rows in the order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """The flagged rows with `island_id`, numbered from 1 in each key.

    A run starts where the row before, flagged or not, is not flagged; so two
    runs that one unflagged row separates stay apart. `order` should be unique
    in a key; equal times need a tie-break column.
    """
    rows = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    starts = flagged.withColumn("_start", F.col("_flag") & ~F.coalesce(F.lag("_flag").over(rows), F.lit(False)))
    # The same partitioning and order serve both windows: one exchange, one sort.
    numbered = starts.withColumn("island_id", F.sum(F.col("_start").cast("long")).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("_flag").drop("_flag", "_start")
