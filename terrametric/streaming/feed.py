"""The live feed: JSON files to records, to tables, windows, alerts and silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import safe_divide
from ..schema import POINT

#: What a message holds; anything else is kept as text among the bad records.
MESSAGE = f"selected_route_id string, display_name string, record_time timestamp, duration_in_seconds double, static_duration_in_seconds double, speed_reading_intervals array<struct<interval_coordinates:array<{POINT}>,speed:string>>"


def read_messages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """One row a message: its text and what it parses to; `ok` tells whether it has a route and a time."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return parsed(lines)


def parsed(lines: DataFrame) -> DataFrame:
    out = lines.select("value", F.from_json("value", MESSAGE).alias("m")).select("value", "m.*")
    return out.withColumn("ok", F.col("selected_route_id").isNotNull() & F.col("record_time").isNotNull())


def records(messages: DataFrame, prefix: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Good records, each once: a repeat of a route and time within the watermark is dropped."""
    good = messages.where("ok").drop("value", "ok")
    if prefix:
        good = good.where(F.col("selected_route_id").startswith(prefix))
    return good.withWatermark("record_time", late).dropDuplicatesWithinWatermark(["selected_route_id", "record_time"])


def bad_messages(messages: DataFrame) -> DataFrame:
    return messages.where(~F.col("ok")).select("value")


def to_table(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Appends to Parquet, a folder a day; exactly once by the checkpoint."""
    dated = rows.withColumn("record_date", F.to_date("record_time"))
    w = dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("record_date").outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def upsert_latest(rows: DataFrame, path: str, checkpoint: str, key: str = "selected_route_id"):
    """Keeps the newest record of each key: every batch is merged into the table and swapped in."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = f"{path}/v={number}"
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        older = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(p)) if fs.exists(p) else []
        older = [v for v in older if v < number]
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v={older[-1]}")) if older else batch
        newest = both.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "record_time").alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(now)
        for v in older[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ratio():
    return safe_divide("duration_in_seconds", "static_duration_in_seconds")


def windowed(rows: DataFrame, length: str = "30 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Mean delay per route and tumbling or sliding window; windows close when the watermark passes them."""
    w = F.window("record_time", length, slide) if slide else F.window("record_time", length)
    grouped = rows.withWatermark("record_time", late).groupBy("selected_route_id", w.alias("w")).agg(F.avg(ratio()).alias("avg_delay_ratio"), F.count("*").alias("samples"))
    return grouped.select("selected_route_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "avg_delay_ratio", "samples")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of records of a route without a gap."""
    grouped = rows.withWatermark("record_time", late).groupBy("selected_route_id", F.session_window("record_time", gap).alias("w")).agg(F.count("*").alias("samples"))
    return grouped.select("selected_route_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "samples")


def alerts(rows: DataFrame, over: float = 2.0) -> DataFrame:
    """Records with a significant delay, as they come."""
    return rows.withColumn("delay_ratio", ratio()).where(F.col("delay_ratio") > over)


def silences(rows: DataFrame, minutes: int = 2, late: str = "0 seconds") -> DataFrame:
    """(selected_route_id, last_arrival, silent_at): a route of which event time passed without a record.

    State is one time a route; a timer fires when the watermark is `minutes`
    past it, and the route speaks again with its next record.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            t = pd.Timestamp(last, unit="ms")
            yield pd.DataFrame({"selected_route_id": [key[0]], "last_arrival": [t], "silent_at": [t + pd.Timedelta(minutes=minutes)]})
            return
        newest = max(int(b["record_time"].max().timestamp() * 1000) for b in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        due = last + minutes * 60_000
        if due <= state.getCurrentWatermarkMs():  # the record came so late that it is silent already
            state.remove()
            t = pd.Timestamp(last, unit="ms")
            yield pd.DataFrame({"selected_route_id": [key[0]], "last_arrival": [t], "silent_at": [t + pd.Timedelta(minutes=minutes)]})
        else:
            state.setTimeoutTimestamp(due)

    timed = rows.select("selected_route_id", "record_time").withWatermark("record_time", late)
    return timed.groupBy("selected_route_id").applyInPandasWithState(watch, "selected_route_id string, last_arrival timestamp, silent_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
