"""Domain tables derived from the driver's tables by arithmetic that SQL can repeat.

Each domain table has a DataFrame here and, under the same name, a CTE in SQL.
Unused columns cost nothing: they are expressions that the optimizer prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import ATTRIBUTES, DAYS, INVALID, LOW_USAGE, RUNNING

#: The month the event table covers, and its end.
FIRST, LAST = "2024-01-01 00:00:00", "2024-01-31 00:00:00"

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_tables(*names: str, body: str) -> str:
    """SQL with the named domain tables as CTEs."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


# --- roads ---

_LINE = [("lng0", "-71.10 + (user_id % 100) * 0.001"), ("lat0", "42.30 + (user_id % 77) * 0.001")]


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    for name, sql in _LINE:
        e = e.withColumn(name, F.expr(sql).cast("double"))
    bend = F.col("event_id") % 3 * 0.0005
    points = [geo.point(F.col("lng0"), F.col("lat0")), geo.point(F.col("lng0") + 0.004, F.col("lat0") + 0.003 + bend), geo.point(F.col("lng0") + 0.009, F.col("lat0") + 0.004)]
    kind = F.when(F.col("event_id") % 50 == 0, "MultiLineString").otherwise("LineString")
    return e.select(
        F.concat(F.lit("route-"), "user_id").alias("selected_route_id"),
        F.concat(F.lit("Corridor "), F.col("user_id") % 40).alias("display_name"),
        F.col("ts").alias("record_time"),
        F.col("value").alias("duration_in_seconds"),
        (20.0 + F.col("user_id") % 30).cast("double").alias("static_duration_in_seconds"),
        geo.geometry(kind, F.array(F.array(*points))).alias("route_geometry"),
        "event_id",
        "user_id",
    )


_X = ("(-71.10 + (user_id % 100) * 0.001)::DOUBLE", "(42.30 + (user_id % 77) * 0.001)::DOUBLE")
_LENGTH = (
    geo.haversine_sql("lng0", "lat0", "lng0 + 0.004::DOUBLE", "lat0 + 0.003::DOUBLE + (event_id % 3) * 0.0005::DOUBLE")
    + " + "
    + geo.haversine_sql("lng0 + 0.004::DOUBLE", "lat0 + 0.003::DOUBLE + (event_id % 3) * 0.0005::DOUBLE", "lng0 + 0.009::DOUBLE", "lat0 + 0.004::DOUBLE")
)
SQL["history"] = f"""
SELECT 'route-' || user_id AS selected_route_id, 'Corridor ' || (user_id % 40) AS display_name, ts AS record_time,
       value AS duration_in_seconds, (20 + user_id % 30)::DOUBLE AS static_duration_in_seconds, event_id, user_id, lng0, lat0,
       CASE WHEN event_id % 50 = 0 THEN 'MultiLineString' ELSE 'LineString' END AS kind, {_LENGTH} AS actual_length
FROM (SELECT *, {_X[0]} AS lng0, {_X[1]} AS lat0 FROM events)"""


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History with speed_reading_intervals: none to three, from the event's number."""
    h = history(spark, sf_dir)
    i = lambda j: F.struct(F.array(geo.point(F.lit(-71.10) + j * 0.001, F.lit(42.30)), geo.point(F.lit(-71.10) + j * 0.001 + F.when((F.col("event_id") + j) % 7 == 0, 0.00001).otherwise(0.002), F.lit(42.301))).alias("interval_coordinates"), F.element_at(F.array(F.lit("NORMAL"), F.lit("SLOW"), F.lit("TRAFFIC_JAM")), (1 + (F.col("event_id") + j) % 3).cast("int")).alias("speed"))
    n = (F.col("event_id") % 4).cast("int")
    return h.withColumn("speed_reading_intervals", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), i)).otherwise(F.array()))


_SLOT = geo.haversine_sql("-71.10::DOUBLE + j * 0.001::DOUBLE", "42.30::DOUBLE", "-71.10::DOUBLE + j * 0.001::DOUBLE + CASE WHEN (event_id + j) % 7 = 0 THEN 0.00001::DOUBLE ELSE 0.002::DOUBLE END", "42.301::DOUBLE")
SQL["intervals"] = f"""
SELECT h.*, j - 1 AS interval_index, list_value('NORMAL', 'SLOW', 'TRAFFIC_JAM')[(1 + (event_id + j) % 3)::INT] AS speed, {_SLOT} AS interval_length
FROM history h, LATERAL unnest(range(1, (event_id % 4)::BIGINT + 1)) t(j)"""


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    low = F.col("c_nationkey") % 5 == 0
    attributes = F.concat(F.lit('{"route_length": "'), (830 + F.col("c_custkey") % 12 * 20).cast("string"), F.lit('", "region": "r'), (F.col("c_nationkey") % 4).cast("string"), F.lit('", "tier": "'), F.element_at(F.array(F.lit("gold"), F.lit("silver"), F.lit("standard")), (1 + F.col("c_custkey") % 3).cast("int")), F.lit('", "priority": "p'), (F.col("c_custkey") % 2).cast("string"), F.lit('"}'))
    return c.select(
        F.concat(F.lit("route-"), "c_custkey").alias("selected_route_id"),
        F.concat(F.lit("Corridor "), F.col("c_custkey") % 40).alias("display_name"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", INVALID).otherwise(RUNNING).alias("status"),
        F.when(low, LOW_USAGE).alias("validation_error"),
        F.when(low, F.timestamp_add("DAY", F.col("c_custkey") % 20, F.lit("2024-01-05 13:30:00").cast("timestamp_ntz"))).alias("low_road_usage_start_time"),
        F.when(F.col("c_custkey") % 11 != 0, attributes).alias("route_attributes"),
    )


SQL["status"] = f"""
SELECT 'route-' || c_custkey AS selected_route_id, 'Corridor ' || (c_custkey % 40) AS display_name,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '{INVALID}' ELSE '{RUNNING}' END AS status,
       CASE WHEN c_nationkey % 5 = 0 THEN '{LOW_USAGE}' END AS validation_error,
       CASE WHEN c_nationkey % 5 = 0 THEN TIMESTAMP '2024-01-05 13:30:00' + to_days((c_custkey % 20)::INT) END AS low_road_usage_start_time,
       CASE WHEN c_custkey % 11 <> 0 THEN '{{"route_length": "' || (830 + c_custkey % 12 * 20) || '", "region": "r' || (c_nationkey % 4)
            || '", "tier": "' || list_value('gold', 'silver', 'standard')[(1 + c_custkey % 3)::INT] || '", "priority": "p' || (c_custkey % 2) || '"}}' END AS route_attributes,
       CASE WHEN c_custkey % 11 <> 0 THEN (830 + c_custkey % 12 * 20)::DOUBLE END AS intended_length
FROM customer"""


# --- places ---


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    of = lambda *names: (lambda i: F.element_at(F.array(*map(F.lit, names)), (1 + i).cast("int")))
    kind = of("restaurant", "bar", "park", "museum", "school", "supermarket", "pub", "cafe")
    nine, five = F.struct(F.lit(9 * 3600).alias("start_time"), F.lit(17 * 3600).alias("end_time")), F.struct(F.lit(18 * 3600).alias("start_time"), F.lit(23 * 3600).alias("end_time"))
    periods = F.when(k % 4 == 0, F.array(nine, five)).when(k % 4 == 1, F.array(nine)).when(k % 4 == 2, F.array(five)).otherwise(F.array().cast("array<struct<start_time:int,end_time:int>>"))
    flags = {a: F.when(k % (11 + i) != 0, k % (i + 2) == 0) for i, a in enumerate(ATTRIBUTES)}
    return p.select(
        F.concat(F.lit("p"), k).alias("id"),
        geo.point(-73.0 - k % 777 / 1000.0, 40.0 + k % 1000 / 1000.0).alias("point"),
        F.array(kind(k % 8), kind(F.col("p_size") % 8)).alias("types"),
        kind(k % 8).alias("primary_type"),
        of("OPERATIONAL", "OPERATIONAL", "OPERATIONAL", "CLOSED_TEMPORARILY", "CLOSED_PERMANENTLY")(k % 5).alias("business_status"),
        F.when(k % 6 != 0, of("PRICE_LEVEL_FREE", "PRICE_LEVEL_INEXPENSIVE", "PRICE_LEVEL_MODERATE", "PRICE_LEVEL_EXPENSIVE", "PRICE_LEVEL_VERY_EXPENSIVE")(F.col("p_size") % 5)).alias("price_level"),
        F.when(k % 9 != 0, 1 + k % 41 / 10.0).alias("rating"),
        *[v.alias(a) for a, v in flags.items()],
        F.struct(*[periods.alias(d) for d in DAYS]).alias("regular_opening_hours"),
        F.array_sort(F.array_distinct(F.array("p_brand", F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"))))).alias("brand_ids"),
        F.array(F.concat(F.lit("city"), (k % 3).cast("string"))).alias("locality_names"),
        F.array(F.concat(F.lit("zip"), (k % 20).cast("string")), F.concat(F.lit("zip"), (k % 7).cast("string"))).alias("postal_code_names"),
        F.concat(F.lit("state"), (k % 2).cast("string")).alias("administrative_area_level_1_name"),
        F.concat(F.lit("hood"), (k % 30).cast("string")).alias("sublocality_level_1_name"),
        of("us", "gb", "fr")(k % 3).alias("country"),
        (k % 10 == 0).alias("is_sample"),
        k.alias("place_key"),
        F.col("p_retailprice").alias("price"),
    )


SQL["places"] = """
SELECT 'p' || p_partkey AS id, (-73.0 - p_partkey % 777 / 1000.0)::DOUBLE AS lng, (40.0 + p_partkey % 1000 / 1000.0)::DOUBLE AS lat,
       list_value(k[(1 + p_partkey % 8)::INT], k[1 + p_size % 8]) AS types, k[(1 + p_partkey % 8)::INT] AS primary_type,
       list_value('OPERATIONAL', 'OPERATIONAL', 'OPERATIONAL', 'CLOSED_TEMPORARILY', 'CLOSED_PERMANENTLY')[(1 + p_partkey % 5)::INT] AS business_status,
       CASE WHEN p_partkey % 6 <> 0 THEN list_value('PRICE_LEVEL_FREE', 'PRICE_LEVEL_INEXPENSIVE', 'PRICE_LEVEL_MODERATE', 'PRICE_LEVEL_EXPENSIVE', 'PRICE_LEVEL_VERY_EXPENSIVE')[1 + p_size % 5] END AS price_level,
       CASE WHEN p_partkey % 9 <> 0 THEN (1 + p_partkey % 41 / 10.0)::DOUBLE END AS rating,
       CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 2 = 0 END AS delivery, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 4 = 0 END AS wheelchair_accessible_entrance,
       CASE WHEN p_partkey % 14 <> 0 THEN p_partkey % 5 = 0 END AS outdoor_seating, CASE WHEN p_partkey % 16 <> 0 THEN p_partkey % 7 = 0 END AS good_for_children, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey % 8 = 0 END AS allows_dogs,
       CASE p_partkey % 4 WHEN 0 THEN [[32400, 61200], [64800, 82800]] WHEN 1 THEN [[32400, 61200]] WHEN 2 THEN [[64800, 82800]] ELSE [] END AS hours,
       list_sort(list_distinct(list_value(p_brand, 'Brand#' || (1 + p_partkey % 5)))) AS brand_ids, list_value('city' || (p_partkey % 3)) AS locality_names,
       list_value('zip' || (p_partkey % 20), 'zip' || (p_partkey % 7)) AS postal_code_names, 'state' || (p_partkey % 2) AS administrative_area_level_1_name,
       'hood' || (p_partkey % 30) AS sublocality_level_1_name, list_value('us', 'gb', 'fr')[(1 + p_partkey % 3)::INT] AS country, p_partkey % 10 = 0 AS is_sample, p_partkey AS place_key, p_retailprice AS price
FROM part, (SELECT list_value('restaurant', 'bar', 'park', 'museum', 'school', 'supermarket', 'pub', 'cafe') AS k)"""


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct().select("id", F.concat(F.lit("Brand "), F.substring("id", 7, 9)).alias("name"))


SQL["brands"] = "SELECT DISTINCT p_brand AS id, 'Brand ' || substr(p_brand, 7) AS name FROM part"


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k).alias("store_id"), geo.point(-73.0 - k * 7 % 777 / 1000.0 + 0.0004, 40.0 + k * 7 % 1000 / 1000.0 + 0.0004).alias("location"), F.col("s_acctbal").alias("balance"), k.alias("store_key"))


SQL["stores"] = "SELECT 's' || s_suppkey AS store_id, (-73.0::DOUBLE - (s_suppkey * 7 % 777) / 1000.0::DOUBLE + 0.0004::DOUBLE) AS lng, (40.0::DOUBLE + (s_suppkey * 7 % 1000) / 1000.0::DOUBLE + 0.0004::DOUBLE) AS lat, s_acctbal AS balance, s_suppkey AS store_key FROM supplier"


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries: a rectangle per nation on a 5 x 5 lattice over the places."""
    k = F.col("n_nationkey")
    west, south = -73.8 + k % 5 * 0.16, 40.0 + F.floor(k / 5) * 0.2
    names = F.struct(F.col("n_name").alias("primary"), F.struct(F.array(F.struct(F.lit("en").alias("key"), F.concat(F.lit("Area "), k).alias("value"))).alias("key_value")).alias("common"))
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("area-"), k).alias("id"), names.alias("names"), F.lit("US").alias("country"), F.concat(F.lit("US-"), F.col("n_regionkey")).alias("region"), F.lit("locality").alias("subtype"), F.when(k % 6 != 5, "land").otherwise("maritime").alias("class"),
        geo.rectangle(west, south, west + 0.15, south + 0.19).alias("geometry"),
    )


SQL["areas"] = """
SELECT 'area-' || n_nationkey AS id, n_name AS name, 'Area ' || n_nationkey AS english, 'US' AS country, 'US-' || n_regionkey AS region, 'locality' AS subtype,
       CASE WHEN n_nationkey % 6 <> 5 THEN 'land' ELSE 'maritime' END AS class,
       -73.8::DOUBLE + n_nationkey % 5 * 0.16::DOUBLE AS west, 40.0::DOUBLE + floor(n_nationkey / 5) * 0.2::DOUBLE AS south,
       -73.8::DOUBLE + n_nationkey % 5 * 0.16::DOUBLE + 0.15::DOUBLE AS east, 40.0::DOUBLE + floor(n_nationkey / 5) * 0.2::DOUBLE + 0.19::DOUBLE AS north
FROM nation"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road segments: two-point lines that begin at the places' lattice."""
    k = F.col("o_orderkey")
    lng, lat = -73.8 + k % 997 / 1000.0, 40.0 + k % 991 / 1000.0
    return table(spark, sf_dir, "orders").select(F.element_at(F.array(F.lit("primary"), F.lit("residential"), F.lit("motorway")), (1 + k % 3).cast("int")).alias("class"), F.when(k % 5 == 0, "rail").otherwise("road").alias("subtype"), geo.make_line(F.array(geo.point(lng, lat), geo.point(lng + 0.002, lat))).alias("geometry"))


SQL["segments"] = "SELECT list_value('primary', 'residential', 'motorway')[(1 + o_orderkey % 3)::INT] AS class, CASE WHEN o_orderkey % 5 = 0 THEN 'rail' ELSE 'road' END AS subtype, -73.8::DOUBLE + (o_orderkey % 997) / 1000.0::DOUBLE AS lng, 40.0::DOUBLE + (o_orderkey % 991) / 1000.0::DOUBLE AS lat FROM orders"


# --- street assets ---


def _class_of(k):
    return F.element_at(F.array(F.lit("ASSET_CLASS_UTILITY_POLE"), F.lit("ASSET_CLASS_ROAD_SIGN"), F.lit("ASSET_CLASS_STREET_LAMP")), (1 + k % 3).cast("int"))


def _where(k):
    return F.struct((40.0 + k % 1000 / 1000.0).cast("double").alias("latitude"), (-73.0 - k % 777 / 1000.0).cast("double").alias("longitude"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    oid = F.concat_ws("-", F.lit("obs"), k, "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("snap-"), F.col("l_suppkey") % 2).alias("snapshot_id"),
        F.concat(F.lit("asset-"), k).alias("asset_id"),
        _class_of(k).alias("asset_type"),
        _where(k).alias("location"),
        F.col("l_shipdate").alias("detection_time"),
        F.timestamp_add("DAY", -30 * F.col("l_linenumber"), "l_shipdate").alias("capture_time"),
        oid.alias("observation_id"),
        F.concat(F.lit("images/"), oid, F.lit(".jpg")).alias("gcs_uri"),
        F.concat(F.lit("maps/"), k).alias("map_url"),
        F.concat(F.lit("[0,0,"), F.col("l_quantity").cast("int"), F.lit("]")).alias("bbox"),
        k.alias("asset_key"),
    )


_CLASS = "list_value('ASSET_CLASS_UTILITY_POLE', 'ASSET_CLASS_ROAD_SIGN', 'ASSET_CLASS_STREET_LAMP')[(1 + {0} % 3)::INT]"
SQL["observations"] = f"""
SELECT 'snap-' || (l_suppkey % 2) AS snapshot_id, 'asset-' || l_orderkey AS asset_id, {_CLASS.format("l_orderkey")} AS asset_type,
       (40.0 + l_orderkey % 1000 / 1000.0)::DOUBLE AS latitude, (-73.0 - l_orderkey % 777 / 1000.0)::DOUBLE AS longitude,
       l_shipdate AS detection_time, l_shipdate - to_days(30 * l_linenumber) AS capture_time,
       'obs-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS observation_id,
       'images/obs-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '.jpg' AS gcs_uri,
       'maps/' || l_orderkey AS map_url, '[0,0,' || l_quantity::INT || ']' AS bbox, l_orderkey AS asset_key
FROM lineitem"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("asset-"), k).alias("asset_id"), F.concat(F.lit("snap-"), k % 2).alias("snapshot_id"), _class_of(k).alias("asset_type"), _where(k).alias("location"))


SQL["assets"] = f"SELECT 'asset-' || o_orderkey AS asset_id, 'snap-' || (o_orderkey % 2) AS snapshot_id, {_CLASS.format('o_orderkey')} AS asset_type, o_orderkey AS asset_key FROM orders"


# --- administration ---


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job log with query texts, from the orders."""
    k = F.col("o_orderkey")
    texts = ["SELECT JSON_EXTRACT_SCALAR(route_attributes, '$.tier'), JSON_EXTRACT_SCALAR(route_attributes, '$.region') FROM routes_status", "SELECT * FROM recent_roads_data, UNNEST(speed_reading_intervals)", "SELECT 1 FROM x JOIN `d.historical_travel_time` USING (id) JOIN `d.routes_status` USING (id)", "SELECT 1 FROM other_table"]
    return table(spark, sf_dir, "orders").select(
        F.concat(F.when(k % 7 == 0, "adhoc_").otherwise("terrametric_"), k).alias("job_id"),
        F.concat(F.lit("user"), F.col("o_custkey") % 20, F.lit("@example.com")).alias("user_email"),
        F.col("o_orderdate").alias("creation_time"),
        F.when(k % 10 == 0, "LOAD").otherwise("QUERY").alias("job_type"),
        F.when(k % 6 == 0, "INSERT").otherwise("SELECT").alias("statement_type"),
        F.element_at(F.array(*map(F.lit, texts)), (1 + k % 4).cast("int")).alias("query"),
        (F.col("o_totalprice") * 1000000).cast("long").alias("total_bytes_billed"),
        (F.col("o_totalprice") * 500000).cast("long").alias("total_bytes_processed"),
    )


_TEXTS = "list_value('SELECT JSON_EXTRACT_SCALAR(route_attributes, ''$.tier''), JSON_EXTRACT_SCALAR(route_attributes, ''$.region'') FROM routes_status', 'SELECT * FROM recent_roads_data, UNNEST(speed_reading_intervals)', 'SELECT 1 FROM x JOIN `d.historical_travel_time` USING (id) JOIN `d.routes_status` USING (id)', 'SELECT 1 FROM other_table')"
SQL["jobs"] = f"""
SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'adhoc_' ELSE 'terrametric_' END || o_orderkey AS job_id, 'user' || (o_custkey % 20) || '@example.com' AS user_email,
       o_orderdate AS creation_time, CASE WHEN o_orderkey % 10 = 0 THEN 'LOAD' ELSE 'QUERY' END AS job_type, CASE WHEN o_orderkey % 6 = 0 THEN 'INSERT' ELSE 'SELECT' END AS statement_type,
       {_TEXTS}[(1 + o_orderkey % 4)::INT] AS query, trunc(o_totalprice * 1000000)::BIGINT AS total_bytes_billed, trunc(o_totalprice * 500000)::BIGINT AS total_bytes_processed
FROM orders"""
