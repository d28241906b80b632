"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC makes civil times explicit; adaptive execution splits skew and coalesces small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def builder(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession.Builder:
    b = SparkSession.builder.master(master).appName("terrametric").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SETTINGS, **more}.items():
        b = b.config(k, v)
    return b
