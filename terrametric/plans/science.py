"""Outliers, features, incidents, clusters and forecasts of travel times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import civil, geo
from ..functions.scalar import json_value, safe_divide
from ..ml import forecast as forecasting
from ..ml.models import clustered
from ..operators.islands import islands
from ..operators.outliers import iqr_outliers
from ..operators.regularize import regularized
from ..schema import RUNNING
from ..sources import driver_tables as tables
from ..sources.driver_tables import FIRST, LAST, with_tables
from .roads import _RATIO, _WINDOW, ROUTE, in_window, ratio

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def measured(spark: SparkSession, sf_dir: str, first: str = FIRST, last: str = LAST) -> DataFrame:
    """Single-path history with its actual and its intended length, null where the route has none."""
    h = in_window(tables.history(spark, sf_dir), first, last).where(geo.is_line("route_geometry")).withColumn("actual_length", geo.length("route_geometry")).drop("route_geometry")
    s = tables.status(spark, sf_dir).select("selected_route_id", "status", json_value("route_attributes", "route_length", "double").alias("intended_length"))
    return h.join(s, "selected_route_id")


def deviation():
    return safe_divide(F.abs(F.col("actual_length") - F.col("intended_length")), "intended_length")


_MEASURED = f"SELECT h.*, s.status, s.intended_length FROM history h JOIN status s USING (selected_route_id) WHERE {_WINDOW} AND kind = 'LineString'"
_SOUND = "abs(actual_length - intended_length) / nullif(intended_length, 0) < 0.05"


def _with(body: str) -> str:
    return with_tables("history", "status", body="").rstrip() + f", measured AS ({_MEASURED})\n" + body


#: A route whose intended length is near the actual one.
SOUND_ROUTE = "route-3"


@query(_with(f"""
, rows AS (SELECT * FROM measured WHERE selected_route_id = '{SOUND_ROUTE}' AND {_SOUND}),
fence AS (SELECT quantile_disc(duration_in_seconds, 0.25) AS q1, quantile_disc(duration_in_seconds, 0.75) AS q3 FROM rows)
SELECT record_time, duration_in_seconds, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound,
       CASE WHEN duration_in_seconds > q3 + 1.5 * (q3 - q1) THEN 'High_Outlier' ELSE 'Low_Outlier' END AS outlier_type
FROM rows, fence WHERE duration_in_seconds > q3 + 1.5 * (q3 - q1) OR duration_in_seconds < q1 - 1.5 * (q3 - q1)"""))
def ds1_outlier_detection(spark: SparkSession, sf_dir: str, route: str = SOUND_ROUTE) -> DataFrame:
    """One route's durations beyond the quartile fences, newest first, after the length check."""
    rows = measured(spark, sf_dir).where((F.col("selected_route_id") == route) & (deviation() < 0.05))
    found = iqr_outliers(rows.select("record_time", "duration_in_seconds"), "duration_in_seconds")
    return found.orderBy(F.desc("record_time"))


_FEATURES = {"am_ratio": (7, 9), "midday_ratio": (12, 14), "pm_ratio": (16, 18)}
_LOCAL_HOUR = "hour(timezone('America/New_York', timezone('UTC', record_time)))"


def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean delay of each route in three parts of the local day, 1.0 where it has none."""
    h, hour = in_window(tables.history(spark, sf_dir)), civil.local_hour("record_time")
    part = lambda a, b: F.coalesce(F.avg(F.when(hour.between(a, b), ratio())), F.lit(1.0))
    return h.groupBy("selected_route_id", "display_name").agg(*[part(*x).alias(n) for n, x in _FEATURES.items()])


@query(with_tables("history", body=f"""
SELECT selected_route_id, display_name, {", ".join(f"round(coalesce(avg(CASE WHEN {_LOCAL_HOUR} BETWEEN {a} AND {b} THEN {_RATIO} END), 1.0), 6) AS {n}" for n, (a, b) in _FEATURES.items())}
FROM history WHERE {_WINDOW} GROUP BY 1, 2"""))
def ds2_route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the clustering is trained on."""
    return route_features(spark, sf_dir).select("selected_route_id", "display_name", *[F.round(n, 6).alias(n) for n in _FEATURES])


@query()
def ds2_similarity_clustering(spark: SparkSession, sf_dir: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Routes in k clusters of alike daily delay."""
    found = clustered(route_features(spark, sf_dir), list(_FEATURES), k, seed)
    return found.select("selected_route_id", "display_name", "cluster_id", *[F.round(n, 2).alias(n) for n in _FEATURES]).orderBy("cluster_id", "selected_route_id")


@query(_with(f"""
, hourly AS (SELECT date_trunc('hour', record_time) AS hour, avg(duration_in_seconds) AS d, count(*) AS n FROM measured WHERE selected_route_id = '{SOUND_ROUTE}' AND {_SOUND} GROUP BY 1),
series AS (SELECT g.hour, d, coalesce(n, 0) AS samples_in_hour FROM (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '2024-01-30', INTERVAL 1 HOUR)) AS hour) g LEFT JOIN hourly USING (hour))
SELECT hour, round(d, 2) AS duration_in_seconds, samples_in_hour, d IS NULL AS is_missing_data, round(lag(d, 1) OVER (ORDER BY hour), 2) AS lag_1hr_duration,
       round(lag(d, 2) OVER (ORDER BY hour), 2) AS lag_2hr_duration, round(avg(d) OVER (ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS rolling_avg_3hr
FROM series"""))
def ds3_feature_engineering(spark: SparkSession, sf_dir: str, route: str = SOUND_ROUTE, first: str = FIRST, last: str = "2024-01-30 00:00:00") -> DataFrame:
    """One route on an hourly grid: missing hours, lags and a rolling mean.

    The windows go by route, so the same plan serves many routes.
    """
    rows = measured(spark, sf_dir).where((F.col("selected_route_id") == route) & (deviation() < 0.05))
    series = regularized(rows, "record_time", [F.avg("duration_in_seconds").alias("d"), F.count("*").alias("n")], first, last).withColumn("route", F.lit(route))
    w = Window.partitionBy("route").orderBy("hour")
    out = series.select(
        "hour", F.round("d", 2).alias("duration_in_seconds"), F.coalesce("n", F.lit(0)).alias("samples_in_hour"), F.col("d").isNull().alias("is_missing_data"),
        F.round(F.lag("d", 1).over(w), 2).alias("lag_1hr_duration"), F.round(F.lag("d", 2).over(w), 2).alias("lag_2hr_duration"), F.round(F.avg("d").over(w.rowsBetween(-2, 0)), 2).alias("rolling_avg_3hr"),
    )
    return out.orderBy(F.desc("hour"))


def _islands_sql(flag: str) -> str:
    order = "PARTITION BY selected_route_id ORDER BY record_time, event_id"
    return f"""
, flagged AS (SELECT *, CASE WHEN {flag} THEN 1 ELSE 0 END AS f FROM rows),
started AS (SELECT *, CASE WHEN f = 1 AND coalesce(lag(f) OVER ({order}), 0) = 0 THEN 1 ELSE 0 END AS s FROM flagged),
streaks AS (SELECT *, sum(s) OVER ({order} ROWS UNBOUNDED PRECEDING) AS island FROM started WHERE f = 1)"""


@query(_with(f", rows AS (SELECT * FROM measured WHERE status = '{RUNNING}')" + _islands_sql("intended_length IS NOT NULL AND (actual_length / nullif(intended_length, 0) > 1.1 OR actual_length / nullif(intended_length, 0) < 0.9)") + """
SELECT selected_route_id, display_name, min(record_time) AS failure_start, max(record_time) AS failure_end, count(*) AS consecutive_records,
       round(avg(actual_length / nullif(intended_length, 0)), 2) AS avg_deviation_ratio, CASE WHEN avg(actual_length) > avg(intended_length) THEN 'OVER_COUNT' ELSE 'UNDER_COUNT' END AS failure_type
FROM streaks GROUP BY selected_route_id, display_name, island ORDER BY failure_start DESC, avg_deviation_ratio DESC, selected_route_id LIMIT 50"""))
def ds4_route_integrity_audit(spark: SparkSession, sf_dir: str, low: float = 0.9, high: float = 1.1, min_records: int = 1, k: int = 50) -> DataFrame:
    """Runs of records whose length is off the intended one; a route without one is never off."""
    rows = measured(spark, sf_dir).where(F.col("status") == RUNNING)
    off = safe_divide("actual_length", "intended_length")
    runs = islands(rows, ["selected_route_id"], ["record_time", "event_id"], F.col("intended_length").isNotNull() & ((off > high) | (off < low)))
    kind = F.when(F.avg("actual_length") > F.avg("intended_length"), "OVER_COUNT").otherwise("UNDER_COUNT")
    found = runs.groupBy("selected_route_id", "display_name", "island_id").agg(F.min("record_time").alias("failure_start"), F.max("record_time").alias("failure_end"), F.count("*").alias("consecutive_records"), F.round(F.avg(off), 2).alias("avg_deviation_ratio"), kind.alias("failure_type"))
    return found.where(F.col("consecutive_records") >= min_records).drop("island_id").orderBy(F.desc("failure_start"), F.desc("avg_deviation_ratio"), "selected_route_id").limit(k)


@query(_with(f", rows AS (SELECT * FROM measured WHERE {_SOUND})" + _islands_sql(f"{_RATIO} > 1.5") + f"""
SELECT selected_route_id, display_name, min(record_time) AS incident_start, max(record_time) AS incident_end, count(*) AS consecutive_samples, round(avg({_RATIO}), 2) AS avg_delay_ratio
FROM streaks GROUP BY selected_route_id, display_name, island HAVING count(*) >= 3 ORDER BY avg_delay_ratio DESC, incident_start DESC, selected_route_id LIMIT 50"""))
def ds5_reliability_ranking(spark: SparkSession, sf_dir: str, over: float = 1.5, min_samples: int = 3, k: int = 50) -> DataFrame:
    """Runs of at least three records with a significant delay."""
    rows = measured(spark, sf_dir).where(deviation() < 0.05)
    runs = islands(rows, ["selected_route_id"], ["record_time", "event_id"], ratio() > over)
    found = runs.groupBy("selected_route_id", "display_name", "island_id").agg(F.min("record_time").alias("incident_start"), F.max("record_time").alias("incident_end"), F.count("*").alias("consecutive_samples"), F.round(F.avg(ratio()), 2).alias("avg_delay_ratio"))
    return found.where(F.col("consecutive_samples") >= min_samples).drop("island_id").orderBy(F.desc("avg_delay_ratio"), F.desc("incident_start"), "selected_route_id").limit(k)


def hourly(spark: SparkSession, sf_dir: str, routes: list[str], first: str, last: str) -> DataFrame:
    h = in_window(tables.history(spark, sf_dir), first, last).where(F.col("selected_route_id").isin(routes))
    return h.groupBy("selected_route_id", F.date_trunc("hour", "record_time").cast("timestamp_ntz").alias("record_hour")).agg(F.avg("duration_in_seconds").alias("duration_in_seconds"))


@query()
def ds6_travel_time_forecasting(spark: SparkSession, sf_dir: str, route: str = ROUTE, horizon: int = 168) -> DataFrame:
    """Three weeks to train, a week ahead, beside what came in the last week."""
    train = hourly(spark, sf_dir, [route], FIRST, "2024-01-21 00:00:00")
    ahead = forecasting.forecast(train, "record_hour", "duration_in_seconds", ["selected_route_id"], horizon)
    actual = hourly(spark, sf_dir, [route], "2024-01-21 00:00:00", "2024-01-29 00:00:00")
    return forecasting.backtest(ahead, actual, "record_hour", "duration_in_seconds", ["selected_route_id"]).orderBy("forecast_timestamp")


@query(with_tables("history", body=f"""
, naive AS (SELECT selected_route_id, date_trunc('hour', record_time) + INTERVAL 7 DAY AS t, avg(duration_in_seconds) AS v FROM history WHERE selected_route_id = '{ROUTE}' AND record_time >= TIMESTAMP '2024-01-14' AND record_time < TIMESTAMP '2024-01-21' GROUP BY 1, 2),
actual AS (SELECT selected_route_id, date_trunc('hour', record_time) AS t, avg(duration_in_seconds) AS a FROM history WHERE selected_route_id = '{ROUTE}' AND record_time >= TIMESTAMP '2024-01-21' AND record_time < TIMESTAMP '2024-01-28' GROUP BY 1, 2)
SELECT n.selected_route_id, t AS forecast_timestamp, round(v, 1) AS forecast_seconds, round(a, 1) AS actual_seconds, round(abs(v - a), 1) AS absolute_error,
       CASE WHEN a BETWEEN v * 0.5 AND v * 1.5 THEN 'YES' ELSE 'NO' END AS within_confidence_interval, round(v * 0.5, 1) AS lower_bound, round(v * 1.5, 1) AS upper_bound
FROM naive n JOIN actual USING (selected_route_id, t)""".lstrip()))
def ds6_backtest_join(spark: SparkSession, sf_dir: str, route: str = ROUTE) -> DataFrame:
    """The backtest's join and labels, on last week's hours taken as a forecast."""
    week = lambda a, b: hourly(spark, sf_dir, [route], a, b).where(F.col("record_hour") < F.lit(b).cast("timestamp_ntz"))
    last = week("2024-01-14 00:00:00", "2024-01-21 00:00:00")
    v = F.col("duration_in_seconds")
    naive = last.select("selected_route_id", F.timestamp_add("DAY", F.lit(7), "record_hour").alias("forecast_timestamp"), v.alias("forecast_value"), (v * 0.5).alias("prediction_interval_lower_bound"), (v * 1.5).alias("prediction_interval_upper_bound"))
    return forecasting.backtest(naive, week("2024-01-21 00:00:00", "2024-01-28 00:00:00"), "record_hour", "duration_in_seconds", ["selected_route_id"])


@query()
def ds7_zero_shot_forecasting(spark: SparkSession, sf_dir: str, routes: tuple = ("route-3", "route-8", "route-11"), horizon: int = 24) -> DataFrame:
    """A day ahead for a few routes from one week; the local model stands in for a hosted one."""
    context = hourly(spark, sf_dir, list(routes), "2024-01-14 00:00:00", "2024-01-21 00:00:00")
    return forecasting.forecast(context, "record_hour", "duration_in_seconds", ["selected_route_id"], horizon).orderBy("selected_route_id", "forecast_timestamp")
