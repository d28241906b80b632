"""Aggregation that withholds small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewer contributing rows than this identify too much.
MINIMUM = 5


def thresholded_agg(df: DataFrame, keys: list[Column | str], aggs: list[Column], k: int = MINIMUM, mode: str = "drop", unit: Column | str | None = None) -> DataFrame:
    """Groups and aggregates; groups of fewer than k units are dropped, or their aggregates null.

    unit: what is counted where rows fan out, such as a place's id; rows by
    default. Without keys the result is one row or none.
    """
    if mode not in ("drop", "null"):
        raise ValueError(f"mode is drop or null, not {mode}")
    count = F.count("*") if unit is None else F.count_distinct(unit)
    grouped = df.groupBy(*keys).agg(*aggs, count.alias("_units"))
    if mode == "drop":
        return grouped.where(F.col("_units") >= k).drop("_units")
    names = grouped.columns[len(keys) : -1]
    return grouped.select(*grouped.columns[: len(keys)], *[F.when(F.col("_units") >= k, F.col(n)).alias(n) for n in names])
