"""Street-asset queries: observations, coverage by year, inference sources, labels, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import civil
from ..sources import driver_tables as tables
from ..sources.driver_tables import with_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
POLE = "ASSET_CLASS_UTILITY_POLE"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(with_tables("observations", body=f"""
SELECT gcs_uri, asset_id, observation_id, detection_time, latitude, longitude FROM observations
WHERE asset_type = '{POLE}' AND asset_id IN (SELECT asset_id FROM observations WHERE asset_type = '{POLE}' GROUP BY 1 HAVING count(observation_id) > 1 ORDER BY asset_id LIMIT 10)"""))
def sv_multi_observation(spark: SparkSession, sf_dir: str, asset_type: str = POLE, k: int = 10) -> DataFrame:
    """All observations of the first assets that have more than one."""
    o = tables.observations(spark, sf_dir).where(F.col("asset_type") == asset_type)
    chosen = o.groupBy("asset_id").agg(F.count("observation_id").alias("n")).where("n > 1").orderBy("asset_id").limit(k).select("asset_id")
    return o.join(chosen, "asset_id", "left_semi").select("gcs_uri", "asset_id", "observation_id", "detection_time", "location.latitude", "location.longitude")


@query(with_tables("observations", body="""
SELECT snapshot_id, asset_id, asset_type, strftime(detection_time, '%Y-%m-%d %H:%M:%S') AS formatted_detection_time, observation_id, bbox,
       strftime(capture_time, '%Y-%m-%d %H:%M:%S') AS formatted_capture_time, gcs_uri, map_url FROM observations WHERE asset_id = 'asset-7'"""))
def sv_one_asset(spark: SparkSession, sf_dir: str, asset: str = "asset-7") -> DataFrame:
    """One asset's observations, newest first."""
    o = tables.observations(spark, sf_dir).where(F.col("asset_id") == asset).orderBy(F.desc("detection_time"), "observation_id")
    return o.select("snapshot_id", "asset_id", "asset_type", civil.formatted("detection_time").alias("formatted_detection_time"), "observation_id", "bbox", civil.formatted("capture_time").alias("formatted_capture_time"), "gcs_uri", "map_url")


@query(with_tables("assets", "observations", body="""
SELECT a.asset_id, a.snapshot_id, a.asset_type, count(DISTINCT o.observation_id) AS observation_count FROM assets a JOIN observations o ON a.asset_id = o.asset_id AND a.snapshot_id = o.snapshot_id GROUP BY 1, 2, 3"""))
def sv_observation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct observations per asset and snapshot."""
    a = tables.assets(spark, sf_dir).select("asset_id", "snapshot_id", "asset_type")
    o = tables.observations(spark, sf_dir).select("asset_id", "snapshot_id", "observation_id")
    return a.join(o, ["asset_id", "snapshot_id"]).groupBy("asset_id", "snapshot_id", "asset_type").agg(F.count_distinct("observation_id").alias("observation_count"))


@query(with_tables("assets", "observations", body="SELECT a.asset_id, a.asset_type FROM assets a LEFT JOIN observations o USING (asset_id) WHERE o.asset_id IS NULL"))
def sv_unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets without an observation."""
    return tables.assets(spark, sf_dir).join(tables.observations(spark, sf_dir).select("asset_id"), "asset_id", "left_anti").select("asset_id", "asset_type")


_PER_ASSET = "SELECT a.asset_id, a.asset_type, count(o.observation_id) AS n FROM assets a LEFT JOIN observations o USING (asset_id) GROUP BY 1, 2"


def per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations per asset, those without any included: counted first, then joined."""
    counts = tables.observations(spark, sf_dir).groupBy("asset_id").agg(F.count("observation_id").alias("n"))
    return tables.assets(spark, sf_dir).select("asset_id", "asset_type").join(counts, "asset_id", "left").select("asset_id", "asset_type", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_tables("assets", "observations", body=_PER_ASSET))
def sv_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations per asset, zero included."""
    return per_asset(spark, sf_dir)


@query(with_tables("assets", "observations", body=f"SELECT replace(asset_type, 'ASSET_CLASS_', '') AS class, CASE WHEN n = 0 THEN 'No Observations' ELSE n::VARCHAR END AS observations, count(*) AS assets FROM ({_PER_ASSET}) GROUP BY 1, 2"))
def sv_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets by class and number of observations."""
    label = F.when(F.col("n") == 0, "No Observations").otherwise(F.col("n").cast("string"))
    return per_asset(spark, sf_dir).groupBy(F.replace("asset_type", F.lit("ASSET_CLASS_"), F.lit("")).alias("class"), label.alias("observations")).agg(F.count("*").alias("assets"))


@query(with_tables("observations", body="""
, c AS (SELECT year(capture_time)::INT AS y, count(DISTINCT observation_id) AS captured FROM observations GROUP BY 1), d AS (SELECT year(detection_time)::INT AS y, count(DISTINCT observation_id) AS detected FROM observations GROUP BY 1)
SELECT coalesce(c.y, d.y) AS year, coalesce(captured, 0) AS captured, coalesce(detected, 0) AS detected FROM c FULL JOIN d ON c.y = d.y"""))
def sv_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by year of capture and of detection; years that one side lacks count zero."""
    o = tables.observations(spark, sf_dir)
    by = lambda t, n: o.groupBy(F.year(t).alias("year")).agg(F.count_distinct("observation_id").alias(n))
    return by("capture_time", "captured").join(by("detection_time", "detected"), "year", "full").select("year", F.coalesce("captured", F.lit(0)).alias("captured"), F.coalesce("detected", F.lit(0)).alias("detected"))


@query(with_tables("observations", body="""
SELECT list_sort(years) AS years, len(years) = 1 AS single_year, count(*) AS assets FROM (SELECT asset_id, list_sort(list(DISTINCT year(capture_time)::INT)) AS years FROM observations GROUP BY 1) GROUP BY ALL"""))
def sv_year_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets by the set of years they were captured in."""
    sets = tables.observations(spark, sf_dir).groupBy("asset_id").agg(F.array_sort(F.collect_set(F.year("capture_time"))).alias("years"))
    return sets.groupBy("years").agg(F.count("*").alias("assets")).select("years", (F.size("years") == 1).alias("single_year"), "assets")


@query(with_tables("observations", body="""
SELECT asset_type, 'capture' AS kind, year(capture_time)::INT AS year, count(*) AS observations FROM observations GROUP BY ALL
UNION ALL SELECT asset_type, 'detection', year(detection_time)::INT, count(*) FROM observations GROUP BY ALL"""))
def sv_class_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class by year and kind of time, long."""
    o = tables.observations(spark, sf_dir).select("asset_type", F.year("capture_time").alias("capture"), F.year("detection_time").alias("detection"))
    return o.unpivot(["asset_type"], ["capture", "detection"], "kind", "year").groupBy("asset_type", "kind", "year").agg(F.count("*").alias("observations"))


@query(with_tables("observations", body="""
SELECT asset_id, latitude, longitude, max(detection_time) AS detection_time, list_sort(list(observation_id)) AS observation_ids, list_sort(list(gcs_uri)) AS gcs_uris
FROM observations WHERE asset_type = 'ASSET_CLASS_ROAD_SIGN' GROUP BY 1, 2, 3"""))
def sv_batch_source(spark: SparkSession, sf_dir: str, asset_type: str = "ASSET_CLASS_ROAD_SIGN") -> DataFrame:
    """What the batch inference reads: an asset with all its observations, in one order."""
    o = tables.observations(spark, sf_dir).where(F.col("asset_type") == asset_type)
    pairs = F.array_sort(F.collect_list(F.struct("observation_id", "gcs_uri"))).alias("pairs")
    grouped = o.groupBy("asset_id", "location").agg(F.max("detection_time").alias("detection_time"), pairs)
    return grouped.select("asset_id", "location.latitude", "location.longitude", "detection_time", F.col("pairs.observation_id").alias("observation_ids"), F.col("pairs.gcs_uri").alias("gcs_uris"))


@query(with_tables("observations", body="SELECT asset_id, list_sort(list(DISTINCT bbox)) AS labels FROM observations GROUP BY 1"))
def sv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels per image group, nulls left out."""
    return tables.observations(spark, sf_dir).groupBy("asset_id").agg(F.array_sort(F.collect_set("bbox")).alias("labels"))


@query(with_tables("observations", body="""
SELECT asset_id, list_sort(list(first_uri)) AS uris FROM (SELECT asset_id, snapshot_id, min(gcs_uri) AS first_uri FROM observations GROUP BY 1, 2) GROUP BY 1"""))
def sv_first_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first image of each evaluation, an array per asset."""
    evaluations = tables.observations(spark, sf_dir).groupBy("asset_id", "snapshot_id").agg(F.array_sort(F.collect_list("gcs_uri")).alias("gcs_uris"))
    return evaluations.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.get("gcs_uris", F.lit(0)))).alias("uris"))


@query(with_tables("observations", body="""
SELECT DISTINCT 'track-' || asset_key AS track_id, printf('%.6f,%.6f', longitude, latitude) AS place, observation_id, gcs_uri AS signed_url, capture_time FROM observations"""))
def sv_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks unnested, joined with their images and metadata."""
    o = tables.observations(spark, sf_dir)
    tracks = o.groupBy("asset_key", "location").agg(F.collect_set("observation_id").alias("ids"))
    flat = tracks.select(F.concat(F.lit("track-"), "asset_key").alias("track_id"), F.format_string("%.6f,%.6f", F.col("location.longitude"), F.col("location.latitude")).alias("place"), F.explode("ids").alias("observation_id"))
    # Both tables have the observation's id: their rows meet in one aggregation and one join.
    known = o.groupBy("observation_id").agg(F.collect_set("gcs_uri").alias("urls"), F.collect_set("capture_time").alias("times"))
    joined = flat.join(known, "observation_id").withColumn("signed_url", F.explode("urls")).withColumn("capture_time", F.explode("times"))
    return joined.select("track_id", "place", "observation_id", "signed_url", "capture_time")


@query(with_tables("observations", body="""
SELECT asset_type, asset_id, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_type ORDER BY detection_time DESC, observation_id, gcs_uri, snapshot_id) AS nth FROM observations) WHERE nth <= 3"""))
def sv_sample(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """A few of each class, the newest, in a stated order."""
    w = Window.partitionBy("asset_type").orderBy(F.desc("detection_time"), "observation_id", "gcs_uri", "snapshot_id")
    return tables.observations(spark, sf_dir).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("asset_type", "asset_id", "observation_id")
