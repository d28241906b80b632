"""Quantile fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quartiles(value: str, exact: bool = True, accuracy: int = 10_000) -> list[Column]:
    """q1 and q3; exact ones by discrete percentiles, approximate ones in bounded memory."""
    f = (lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")) if exact else (lambda p: F.percentile_approx(value, p, accuracy))
    return [f(0.25).alias("q1"), f(0.75).alias("q3")]


def iqr_outliers(df: DataFrame, value: str, keys: list[str] | None = None, width: float = 1.5, exact: bool = True) -> DataFrame:
    """Rows beyond the fences, with lower_bound, upper_bound and outlier_type.

    Without keys the fences are one row; with keys they are joined by key.
    """
    keys = keys or []
    fences = df.groupBy(*keys).agg(*quartiles(value, exact))
    fences = fences.select(*keys, (F.col("q1") - width * (F.col("q3") - F.col("q1"))).alias("lower_bound"), (F.col("q3") + width * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    joined = df.join(fences, keys) if keys else df.join(F.broadcast(fences))
    kind = F.when(F.col(value) > F.col("upper_bound"), "High_Outlier").when(F.col(value) < F.col("lower_bound"), "Low_Outlier")
    return joined.withColumn("outlier_type", kind).where("outlier_type is not null")
