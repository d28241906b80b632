"""Road travel-time queries: traffic operations, urban planning, usage planning.

Every query states its tie-break, takes its window as parameters, and joins the
history to one row per route, which Spark broadcasts only where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import civil, geo
from ..functions.scalar import json_value, safe_divide
from ..schema import LOW_USAGE, RUNNING
from ..sources import driver_tables as tables
from ..sources.driver_tables import FIRST, LAST, with_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ROUTE = "route-8"
#: A study area over a part of the routes, west, south, east, north.
AREA = (-71.075, 42.315, -71.045, 42.345)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def ratio() -> Column:
    return safe_divide("duration_in_seconds", "static_duration_in_seconds")


def in_window(df: DataFrame, first: str = FIRST, last: str = LAST) -> DataFrame:
    return df.where(civil.between("record_time", first, last))


_RATIO = "duration_in_seconds / nullif(static_duration_in_seconds, 0)"
_WINDOW = f"record_time BETWEEN TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}'"
_LOCAL = "timezone('America/New_York', timezone('UTC', record_time))"

# --- traffic operations ---


@query(with_tables("history", "status", body=f"""
SELECT display_name, round(avg(r), 3) AS avg_delay_ratio, count(*) AS sample_count
FROM (SELECT h.display_name, {_RATIO} AS r FROM history h JOIN status s USING (selected_route_id)
      WHERE {_WINDOW} AND s.status = '{RUNNING}' AND kind = 'LineString' AND hour({_LOCAL}) BETWEEN 7 AND 8)
GROUP BY 1 HAVING round(avg(r), 3) > 1.0 ORDER BY avg_delay_ratio DESC, display_name LIMIT 10"""))
def tom1_peak_hour_delay(spark: SparkSession, sf_dir: str, first: str = FIRST, last: str = LAST, hours: tuple[int, int] = (7, 8), k: int = 10) -> DataFrame:
    """Display names with the highest mean delay in the local morning peak."""
    h = in_window(tables.history(spark, sf_dir), first, last).where(geo.is_line("route_geometry") & civil.local_hour("record_time").between(*hours))
    running = tables.status(spark, sf_dir).where(F.col("status") == RUNNING).select("selected_route_id")
    found = h.join(running, "selected_route_id").groupBy("display_name").agg(F.round(F.avg(ratio()), 3).alias("avg_delay_ratio"), F.count("*").alias("sample_count"))
    return found.where("avg_delay_ratio > 1.0").orderBy(F.desc("avg_delay_ratio"), "display_name").limit(k)


@query(with_tables("history", "intervals", body=f"""
SELECT selected_route_id, display_name, count(*) AS traffic_jam_count FROM intervals
WHERE {_WINDOW} AND speed = 'TRAFFIC_JAM' GROUP BY 1, 2 ORDER BY traffic_jam_count DESC, selected_route_id LIMIT 10"""))
def tom2_persistent_bottlenecks(spark: SparkSession, sf_dir: str, first: str = FIRST, last: str = LAST, k: int = 10) -> DataFrame:
    """Routes with the most jammed intervals; records without intervals vanish."""
    r = in_window(tables.recent(spark, sf_dir), first, last)
    speeds = r.select("selected_route_id", "display_name", F.explode("speed_reading_intervals.speed").alias("speed"))
    found = speeds.where("speed = 'TRAFFIC_JAM'").groupBy("selected_route_id", "display_name").agg(F.count("*").alias("traffic_jam_count"))
    return found.orderBy(F.desc("traffic_jam_count"), "selected_route_id").limit(k)


@query(with_tables("status", body=f"""
SELECT display_name, selected_route_id, status, validation_error, low_road_usage_start_time,
       date_diff('day', low_road_usage_start_time::DATE, DATE '2024-01-31')::INT AS days_in_error_state
FROM status WHERE status = '{RUNNING}' AND validation_error = '{LOW_USAGE}'"""))
def tom3_operational_health(spark: SparkSession, sf_dir: str, as_of: str = LAST) -> DataFrame:
    """Running routes with too little traffic, by midnights since it began."""
    s = tables.status(spark, sf_dir).where((F.col("status") == RUNNING) & (F.col("validation_error") == LOW_USAGE))
    days = civil.days_crossed("low_road_usage_start_time", F.lit(as_of).cast("timestamp_ntz"))
    out = s.select("display_name", "selected_route_id", "status", "validation_error", "low_road_usage_start_time", days.alias("days_in_error_state"))
    return out.orderBy(F.desc("days_in_error_state"), "selected_route_id")


@query(with_tables("history", "status", body=f"""
SELECT s.selected_route_id, s.display_name, last_arrival, date_sub('minute', last_arrival, TIMESTAMP '{LAST}') AS minutes_of_silence
FROM status s JOIN (SELECT selected_route_id, max(record_time) AS last_arrival FROM history WHERE {_WINDOW} GROUP BY 1) USING (selected_route_id)
WHERE s.status = '{RUNNING}' AND last_arrival < TIMESTAMP '{LAST}' - INTERVAL 2 MINUTE"""))
def tom4_data_latency(spark: SparkSession, sf_dir: str, first: str = FIRST, last: str = LAST, silent_minutes: int = 2, include_never: bool = False) -> DataFrame:
    """Running routes that fell silent before the window's end; those never seen only on request."""
    end = F.lit(last).cast("timestamp_ntz")
    arrivals = in_window(tables.history(spark, sf_dir), first, last).groupBy("selected_route_id").agg(F.max("record_time").alias("last_arrival"))
    running = tables.status(spark, sf_dir).where(F.col("status") == RUNNING).select("selected_route_id", "display_name")
    joined = running.join(arrivals, "selected_route_id", "left" if include_never else "inner")
    silent = joined.where(F.col("last_arrival").isNull() | (F.col("last_arrival") < end - F.expr(f"INTERVAL {silent_minutes} MINUTES")))
    return silent.withColumn("minutes_of_silence", civil.elapsed("MINUTE", F.col("last_arrival"), end)).orderBy(F.desc_nulls_first("minutes_of_silence"), "selected_route_id")


@query(with_tables("history", "status", body=f"""
SELECT h.display_name, h.selected_route_id, record_time, duration_in_seconds, static_duration_in_seconds, round({_RATIO}, 2) AS delay_ratio
FROM history h JOIN status s USING (selected_route_id)
WHERE record_time BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '{LAST}' AND s.status = '{RUNNING}' AND {_RATIO} > 2.0 AND kind = 'LineString'"""))
def tom5_significant_event_detection(spark: SparkSession, sf_dir: str, first: str = "2024-01-29 00:00:00", last: str = LAST, over: float = 2.0) -> DataFrame:
    """Records of the last days with more than twice the static duration."""
    h = in_window(tables.history(spark, sf_dir), first, last).where(geo.is_line("route_geometry") & (ratio() > over))
    running = tables.status(spark, sf_dir).where(F.col("status") == RUNNING).select("selected_route_id")
    out = h.join(running, "selected_route_id").select("display_name", "selected_route_id", "record_time", "duration_in_seconds", "static_duration_in_seconds", F.round(ratio(), 2).alias("delay_ratio"))
    return out.orderBy(F.desc("delay_ratio"), "selected_route_id", "record_time")


# --- urban planning ---


@query(with_tables("history", body=f"""
SELECT selected_route_id, strftime(week, '%Y-%W') AS year_week, round(avg(r), 3) AS avg_delay_ratio
FROM (SELECT selected_route_id, (record_time::DATE - dayofweek(record_time)::INT)::DATE AS week, {_RATIO} AS r FROM history WHERE selected_route_id = '{ROUTE}' AND {_WINDOW})
GROUP BY selected_route_id, week"""))
def up1_corridor_trend(spark: SparkSession, sf_dir: str, route: str = ROUTE, first: str = FIRST, last: str = LAST) -> DataFrame:
    """A route's mean delay by week from Sunday."""
    h = in_window(tables.history(spark, sf_dir), first, last).where(F.col("selected_route_id") == route)
    weeks = h.groupBy("selected_route_id", civil.sunday_week("record_time").alias("week")).agg(F.round(F.avg(ratio()), 3).alias("avg_delay_ratio"))
    return weeks.orderBy("week").select("selected_route_id", civil.year_week("week").alias("year_week"), "avg_delay_ratio")


_W, _S, _E, _N = AREA
_TOUCHES = f"lng0 <= {_E} AND lng0 + 0.009 >= {_W} AND lat0 <= {_N} AND lat0 + 0.004 >= {_S}"


def crossing(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose line meets a rectangle given as constants."""
    return df.where(geo.intersects("route_geometry", geo.rectangle(west, south, east, north)))


def _segment_meets(x1: str, y1: str, x2: str, y2: str) -> str:
    """SQL for a segment that meets the area, by clipping its parameter to both slabs; x2 > x1 and y2 <> y1 here."""
    tx = [f"(({b}) - ({x1})) / (({x2}) - ({x1}))" for b in (_W, _E)]
    ty = [f"(({b}) - ({y1})) / (({y2}) - ({y1}))" for b in (_S, _N)]
    return f"greatest(0, {tx[0]}, least({ty[0]}, {ty[1]})) <= least(1, {tx[1]}, greatest({ty[0]}, {ty[1]}))"


_BEND = "lat0 + 0.003::DOUBLE + (event_id % 3) * 0.0005::DOUBLE"
_FIRST_LEG = _segment_meets("lng0", "lat0", "lng0 + 0.004::DOUBLE", _BEND)
_LAST_LEG = f"(CASE WHEN event_id % 3 = 2 THEN lng0 + 0.009 >= {_W} AND lng0 + 0.004 <= {_E} AND lat0 + 0.004 BETWEEN {_S} AND {_N} ELSE " + _segment_meets("lng0 + 0.004::DOUBLE", _BEND, "lng0 + 0.009::DOUBLE", "lat0 + 0.004::DOUBLE - (CASE WHEN event_id % 3 = 2 THEN 0.1::DOUBLE ELSE 0 END)") + " END)"
_MEETS = f"{_TOUCHES} AND ({_FIRST_LEG} OR {_LAST_LEG})"


@query(with_tables("history", body=f"""
SELECT record_time >= TIMESTAMP '2024-01-15' AS is_after_completion, round(avg({_RATIO}), 3) AS avg_delay_ratio, count(*) AS sample_count
FROM history WHERE {_WINDOW} AND {_MEETS} GROUP BY 1"""))
def up2_impact_analysis(spark: SparkSession, sf_dir: str, area: tuple = AREA, completed: str = "2024-01-15 00:00:00", first: str = FIRST, last: str = LAST) -> DataFrame:
    """Mean delay before and after a milestone on lines through a study area."""
    h = crossing(in_window(tables.history(spark, sf_dir), first, last), *area)
    after = (F.col("record_time") >= F.lit(completed).cast("timestamp_ntz")).alias("is_after_completion")
    return h.groupBy(after).agg(F.round(F.avg(ratio()), 3).alias("avg_delay_ratio"), F.count("*").alias("sample_count")).orderBy("is_after_completion")


@query(with_tables("history", body=f"""
SELECT lat_grid, lon_grid, count(DISTINCT selected_route_id) AS unique_routes_monitored, count(*) AS total_samples_collected FROM (
  SELECT selected_route_id, round(((lat0 + {_BEND}) / 2 * w1 + ({_BEND} + lat0 + 0.004::DOUBLE) / 2 * w2) / (w1 + w2), 3) AS lat_grid,
         round(((lng0 + lng0 + 0.004::DOUBLE) / 2 * w1 + (lng0 + 0.004::DOUBLE + lng0 + 0.009::DOUBLE) / 2 * w2) / (w1 + w2), 3) AS lon_grid
  FROM (SELECT *, {geo.haversine_sql("lng0", "lat0", "lng0 + 0.004::DOUBLE", _BEND)} AS w1, {geo.haversine_sql("lng0 + 0.004::DOUBLE", _BEND, "lng0 + 0.009::DOUBLE", "lat0 + 0.004::DOUBLE")} AS w2 FROM history WHERE {_WINDOW})
) GROUP BY 1, 2 ORDER BY unique_routes_monitored DESC, total_samples_collected DESC, lat_grid, lon_grid LIMIT 20"""))
def up3_monitoring_density(spark: SparkSession, sf_dir: str, first: str = FIRST, last: str = LAST, digits: int = 3, k: int = 20) -> DataFrame:
    """Cells of 0.001 degrees with the most routes, by the lines' centroids."""
    c = in_window(tables.history(spark, sf_dir), first, last).select("selected_route_id", geo.centroid("route_geometry").alias("c"))
    cells = c.groupBy(F.round("c.lat", digits).alias("lat_grid"), F.round("c.lng", digits).alias("lon_grid"))
    found = cells.agg(F.count_distinct("selected_route_id").alias("unique_routes_monitored"), F.count("*").alias("total_samples_collected"))
    return found.orderBy(F.desc("unique_routes_monitored"), F.desc("total_samples_collected"), "lat_grid", "lon_grid").limit(k)


@query(with_tables("history", body=f"""
SELECT CASE WHEN dayofweek({_LOCAL}) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type, round(avg({_RATIO}), 3) AS avg_delay_ratio,
       round(avg(duration_in_seconds), 2) AS avg_duration_seconds, count(*) AS sample_count
FROM history WHERE {_WINDOW} AND hour({_LOCAL}) BETWEEN 14 AND 17 GROUP BY 1"""))
def up4_weekend_vs_weekday(spark: SparkSession, sf_dir: str, first: str = FIRST, last: str = LAST, hours: tuple[int, int] = (14, 17)) -> DataFrame:
    """Afternoon delay on weekdays and weekends in local time."""
    h = in_window(tables.history(spark, sf_dir), first, last).where(civil.local_hour("record_time").between(*hours))
    kind = F.when(civil.is_weekend("record_time"), "Weekend").otherwise("Weekday").alias("day_type")
    out = h.groupBy(kind).agg(F.round(F.avg(ratio()), 3).alias("avg_delay_ratio"), F.round(F.avg("duration_in_seconds"), 2).alias("avg_duration_seconds"), F.count("*").alias("sample_count"))
    return out.orderBy(F.desc("avg_delay_ratio"))


@query(with_tables("history", body=f"""
SELECT selected_route_id, display_name, round(avg({_RATIO}), 3) AS avg_delay_ratio, count(*) AS sample_count
FROM history WHERE {_WINDOW} AND kind = 'LineString' AND {_MEETS} GROUP BY 1, 2 HAVING round(avg({_RATIO}), 3) > 1.5"""))
def up5_geofenced_congestion(spark: SparkSession, sf_dir: str, area: tuple = AREA, over: float = 1.5, first: str = FIRST, last: str = LAST) -> DataFrame:
    """Routes through a zone whose mean delay exceeds a threshold."""
    h = crossing(in_window(tables.history(spark, sf_dir), first, last).where(geo.is_line("route_geometry")), *area)
    found = h.groupBy("selected_route_id", "display_name").agg(F.round(F.avg(ratio()), 3).alias("avg_delay_ratio"), F.count("*").alias("sample_count"))
    return found.where(F.col("avg_delay_ratio") > over).orderBy(F.desc("avg_delay_ratio"), "selected_route_id")


# --- usage planning ---


@query(with_tables("history", body=f"""
SELECT round(a, 2) AS avg_records_per_route_per_day, 5000 AS target_route_count, round(a * 5000, 0) AS estimated_total_daily_records, round(a * 5000 * 30 / 1000000, 2) AS estimated_monthly_millions
FROM (SELECT avg(n) AS a FROM (SELECT count(*) AS n FROM history WHERE {_WINDOW} GROUP BY record_time::DATE, selected_route_id))"""))
def rmip1_usage_projection(spark: SparkSession, sf_dir: str, routes: int = 5000, first: str = FIRST, last: str = LAST) -> DataFrame:
    """Mean records a route and day, carried on to a number of routes."""
    days = in_window(tables.history(spark, sf_dir), first, last).groupBy(F.to_date("record_time"), "selected_route_id").agg(F.count("*").alias("n"))
    a = F.avg("n")
    return days.agg(F.round(a, 2).alias("avg_records_per_route_per_day"), F.lit(routes).alias("target_route_count"), F.round(a * routes, 0).alias("estimated_total_daily_records"), F.round(a * routes * 30 / 1000000, 2).alias("estimated_monthly_millions"))


@query(with_tables("history", "status", body=f"""
SELECT json_extract_string(route_attributes, '$.tier') AS service_tier, round(sum(duration_in_seconds - static_duration_in_seconds) / 3600, 1) AS total_delay_hours,
       count(DISTINCT h.selected_route_id) AS monitored_routes, round(avg({_RATIO}), 2) AS avg_delay_index
FROM history h JOIN status s USING (selected_route_id) WHERE {_WINDOW} AND duration_in_seconds > static_duration_in_seconds
GROUP BY 1 HAVING service_tier IS NOT NULL"""))
def rmip2_customer_roi(spark: SparkSession, sf_dir: str, first: str = FIRST, last: str = LAST) -> DataFrame:
    """Delay by service tier, over records slower than free flow."""
    h = in_window(tables.history(spark, sf_dir), first, last).where("duration_in_seconds > static_duration_in_seconds")
    tiers = tables.status(spark, sf_dir).select("selected_route_id", json_value("route_attributes", "tier").alias("service_tier")).where("service_tier is not null")
    delay = F.sum(F.col("duration_in_seconds") - F.col("static_duration_in_seconds")) / 3600
    out = h.join(tiers, "selected_route_id").groupBy("service_tier").agg(F.round(delay, 1).alias("total_delay_hours"), F.count_distinct("selected_route_id").alias("monitored_routes"), F.round(F.avg(ratio()), 2).alias("avg_delay_index"))
    return out.orderBy(F.desc("total_delay_hours"))


@query(with_tables("areas", "segments", body=f"""
SELECT s.class AS road_class, s.subtype, count(*) AS segment_count, round(sum({geo.haversine_sql("lng", "lat", "lng + 0.002::DOUBLE", "lat")}) / 1000, 2) AS total_length_km
FROM segments s JOIN areas a ON lng <= east AND lng + 0.002::DOUBLE >= west AND lat BETWEEN south AND north
WHERE s.subtype = 'road' AND a.name = 'NATION_12' AND a.class = 'land' GROUP BY 1, 2"""))
def rmip3_segment_estimation(spark: SparkSession, sf_dir: str, name: str = "NATION_12") -> DataFrame:
    """Road segments and kilometres that meet a boundary, by class."""
    area = tables.areas(spark, sf_dir).where((F.col("names.primary") == name) & (F.col("class") == "land")).select("geometry").limit(2).collect()
    if len(area) != 1:
        raise ValueError(f"{len(area)} boundaries are named {name}")
    # One boundary: a constant, of which the box is compared first.
    ring = area[0]["geometry"]["parts"][0]
    boundary = geo.geometry("Polygon", F.array(F.array(*[geo.point(F.lit(p["lng"]), F.lit(p["lat"])) for p in ring])))
    s = tables.segments(spark, sf_dir).where(F.col("subtype") == "road").where(geo.intersects("geometry", boundary))
    out = s.groupBy(F.col("class").alias("road_class"), "subtype").agg(F.count("*").alias("segment_count"), F.round(F.sum(geo.length("geometry")) / 1000, 2).alias("total_length_km"))
    return out.orderBy(F.desc("segment_count"), "road_class")


@query(with_tables("areas", body="""
SELECT id AS division_id, name AS area_name, region, country, west, south, east, north FROM areas
WHERE name = 'NATION_12' AND country = 'US' AND class = 'land'"""))
def rmip4_area_boundary(spark: SparkSession, sf_dir: str, name: str = "NATION_12", country: str = "US") -> DataFrame:
    """A reusable boundary, with its box."""
    a = tables.areas(spark, sf_dir).where((F.col("names.primary") == name) & (F.col("country") == country) & (F.col("class") == "land"))
    return a.select(F.col("id").alias("division_id"), F.col("names.primary").alias("area_name"), "region", "country", geo.bounds("geometry").alias("b")).select("division_id", "area_name", "region", "country", "b.*")


# --- tutorial ---


@query(with_tables("history", "status", body=f"""
SELECT h.selected_route_id, h.display_name, record_time, duration_in_seconds, static_duration_in_seconds, round({_RATIO}, 2) AS travel_time_index
FROM history h JOIN status s USING (selected_route_id)
WHERE record_time >= TIMESTAMP '2024-01-30' AND record_time < TIMESTAMP '{LAST}' AND kind = 'LineString' ORDER BY record_time DESC, event_id LIMIT 10"""))
def tt_gold(spark: SparkSession, sf_dir: str, as_of: str = LAST, k: int = 10) -> DataFrame:
    """The newest records of the last 24 hours, with their travel-time index."""
    end = F.lit(as_of).cast("timestamp_ntz")
    h = tables.history(spark, sf_dir).where((F.col("record_time") >= end - F.expr("INTERVAL 24 HOURS")) & (F.col("record_time") < end) & geo.is_line("route_geometry"))
    joined = h.join(tables.status(spark, sf_dir).select("selected_route_id"), "selected_route_id")
    return joined.orderBy(F.desc("record_time"), "event_id").limit(k).select("selected_route_id", "display_name", "record_time", "duration_in_seconds", "static_duration_in_seconds", F.round(ratio(), 2).alias("travel_time_index"))


@query(with_tables("history", body="""
SELECT dow, """ + ", ".join(f"max(CASE WHEN hr = {h} THEN r END) AS h{h}" for h in range(24)) + f"""
FROM (SELECT (dayofweek(record_time) + 1)::INT AS dow, hour(record_time) AS hr, round(avg({_RATIO}), 3) AS r FROM history GROUP BY 1, 2) GROUP BY dow"""))
def tt_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean index by day of week and UTC hour, hours as columns."""
    h = tables.history(spark, sf_dir).select(F.dayofweek("record_time").alias("dow"), F.hour("record_time").alias("hr"), ratio().alias("r"))
    wide = h.groupBy("dow").pivot("hr", list(range(24))).agg(F.round(F.avg("r"), 3))
    return wide.select("dow", *[F.col(str(x)).alias(f"h{x}") for x in range(24)])


@query(with_tables("history", body="""
SELECT selected_route_id, count(*) AS records, max(record_time) AS newest FROM history
WHERE record_time >= (SELECT date_trunc('day', max(record_time)) FROM history) GROUP BY 1"""))
def tt_freshest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the latest day only; the day is a scalar found first, so the scan is pruned by it."""
    h = tables.history(spark, sf_dir)
    latest = h.agg(F.date_trunc("day", F.max("record_time")).cast("timestamp_ntz")).first()[0]
    return h.where(F.col("record_time") >= F.lit(latest)).groupBy("selected_route_id").agg(F.count("*").alias("records"), F.max("record_time").alias("newest"))
