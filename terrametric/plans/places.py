"""Point-of-interest queries: densities, catchments, scores, leads, and the dynamic search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, grid
from ..functions.scalar import clamp
from ..ml.models import regression
from ..operators.density import DensityRequest, near, places_count_per_cell
from ..operators.spatial_join import left_within_distance, points_in_polygons, within_distance
from ..operators.threshold import MINIMUM, thresholded_agg
from ..sources import catalog
from ..sources import driver_tables as tables
from ..sources.driver_tables import with_tables
from .search import Circle, Polygon, Region, Route, SearchRequest, search

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def has(kind: str):
    return F.array_contains("types", kind)


CELL = 0.05
_SQUARE = f"floor(lng / {CELL}::DOUBLE)::BIGINT || ':' || floor(lat / {CELL}::DOUBLE)::BIGINT"
_BAR, _FOOD = "list_contains(types, 'bar')", "list_contains(types, 'restaurant')"


def _bars_and_restaurants(spark, sf_dir, cell):
    p = catalog.places_of(tables.places(spark, sf_dir), "us").where(F.array_contains("locality_names", "city0") & (F.col("administrative_area_level_1_name") == "state0") & (has("bar") | has("restaurant")))
    found = thresholded_agg(p.withColumn("cell", cell(F.col("point"))), ["cell"], [F.count_if(has("bar")).alias("bar_count"), F.count_if(has("restaurant")).alias("restaurant_count"), F.count("*").alias("total_count")], 2)
    return found.orderBy(F.desc("total_count"), "cell")


@query(with_tables("places", body=f"""
SELECT {_SQUARE} AS cell, count_if({_BAR}) AS bar_count, count_if({_FOOD}) AS restaurant_count, count(*) AS total_count FROM places
WHERE country = 'us' AND list_contains(locality_names, 'city0') AND administrative_area_level_1_name = 'state0' AND ({_BAR} OR {_FOOD}) GROUP BY 1 HAVING count(*) >= 2"""))
def pl_cells_bars_restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and restaurants of one city per square cell; cells with fewer than two are withheld."""
    return _bars_and_restaurants(spark, sf_dir, grid.cells("square", CELL))


@query()
def pl_s2_bars_restaurants(spark: SparkSession, sf_dir: str, level: int = 10) -> DataFrame:
    """The same per S2 cell, with its corners."""
    found = _bars_and_restaurants(spark, sf_dir, grid.cells("s2", level))
    return found.select(F.col("cell").alias("s2_cell_id"), geo.as_text(grid.s2_boundary("cell")).alias("s2_geography"), "bar_count", "restaurant_count", "total_count")


@query()
def pl_s2_bars(spark: SparkSession, sf_dir: str, level: int = 9) -> DataFrame:
    """Bars of another country's city per S2 cell."""
    p = catalog.places_of(tables.places(spark, sf_dir), "fr").where(F.array_contains("locality_names", "city2") & has("bar"))
    found = thresholded_agg(p.withColumn("s2_cell_id", grid.s2_id(F.col("point"), level)), ["s2_cell_id"], [F.count("*").alias("bar_count")], 2)
    return found.orderBy(F.desc("bar_count"), "s2_cell_id")


def boundary(spark: SparkSession, sf_dir: str, english: str) -> DataFrame:
    """The land area with an English name; more than one is an error. Holes are dropped."""
    a = tables.areas(spark, sf_dir).where(F.exists("names.common.key_value", lambda x: (x["key"] == "en") & (x["value"] == english)) & (F.col("class") == "land")).limit(2)
    if (n := a.count()) != 1:
        raise ValueError(f"{n} areas are named {english}")
    return a.select("id", geo.exterior("geometry").alias("geometry"))


@query(with_tables("places", "areas", body=f"""
SELECT {_SQUARE} AS cell, count(*) AS pub_count FROM places p JOIN areas a ON lng >= west AND lng < east AND lat >= south AND lat < north
WHERE a.english = 'Area 12' AND a.class = 'land' AND p.country = 'gb' AND list_contains(types, 'pub') GROUP BY 1 HAVING count(*) >= 2"""))
def pl_cells_in_boundary(spark: SparkSession, sf_dir: str, kind: str = "pub", english: str = "Area 12") -> DataFrame:
    """Places of a kind inside a boundary found by name, per square cell."""
    p = catalog.places_of(tables.places(spark, sf_dir), "gb").where(has(kind))
    inside = points_in_polygons(p.select("point"), boundary(spark, sf_dir, english).select("geometry"), "point", "geometry")
    found = thresholded_agg(inside.withColumn("cell", grid.square_id(F.col("point"), CELL)), ["cell"], [F.count("*").alias("pub_count")], 2)
    return found.orderBy(F.desc("pub_count"), "cell")


@query(with_tables("places", "areas", body=f"""
SELECT {_SQUARE.replace("0.05", "0.02")} AS cell, count(*) AS tourist_attraction_count FROM places p JOIN areas a ON lng >= west AND lng < east AND lat >= south AND lat < north
WHERE a.name = 'NATION_7' AND p.country = 'fr' AND list_contains(types, 'museum') GROUP BY 1"""))
def pl_cells_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attractions inside the area with a primary name, per finer cell, without a threshold."""
    a = tables.areas(spark, sf_dir).where((F.col("country") == "US") & (F.col("names.primary") == "NATION_7")).select("geometry")
    p = catalog.places_of(tables.places(spark, sf_dir), "fr").where(has("museum")).select("point")
    inside = points_in_polygons(p, a, "point", "geometry")
    return inside.groupBy(grid.square_id(F.col("point"), 0.02).alias("cell")).agg(F.count("*").alias("tourist_attraction_count")).orderBy(F.desc("tourist_attraction_count"), "cell")


CENTRE = (-73.3, 40.3)
_NEAR = geo.haversine_sql("lng", "lat", f"{CENTRE[0]}::DOUBLE", f"{CENTRE[1]}::DOUBLE")


@query(with_tables("places", body=f"SELECT {_SQUARE} AS cell, count(*) AS place_count FROM places WHERE {_NEAR} <= 20000 AND primary_type = 'restaurant' GROUP BY 1"))
def pl_cells_in_radius(spark: SparkSession, sf_dir: str, metres: float = 20_000) -> DataFrame:
    """Restaurants within a radius per square cell."""
    p = near(tables.places(spark, sf_dir), "point", *CENTRE, metres).where(F.col("primary_type") == "restaurant")
    return p.groupBy(grid.square_id(F.col("point"), CELL).alias("cell")).agg(F.count("*").alias("place_count"))


@query(with_tables("places", body=f"SELECT sublocality_level_1_name AS neighborhood_name, count(*) AS restaurant_count FROM places WHERE {_FOOD} AND administrative_area_level_1_name = 'state0' GROUP BY 1 HAVING count(*) >= {MINIMUM}"))
def pl_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restaurants per neighbourhood name; small ones are withheld."""
    p = tables.places(spark, sf_dir).where(has("restaurant") & (F.col("administrative_area_level_1_name") == "state0"))
    return thresholded_agg(p, [F.col("sublocality_level_1_name").alias("neighborhood_name")], [F.count("*").alias("restaurant_count")]).orderBy(F.desc("restaurant_count"), "neighborhood_name")


@query(with_tables("places", "areas", body=f"""
SELECT a.id AS area_id, a.name AS area_name, count(*) AS restaurant_count, 5 AS corners FROM places p JOIN areas a ON lng >= west AND lng < east AND lat >= south AND lat < north
WHERE {_FOOD} AND west >= -73.9 AND east <= -73.3 AND south >= 39.9 AND north <= 40.7 GROUP BY 1, 2 HAVING count(*) >= {MINIMUM}"""))
def pl_choropleth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restaurants per area inside a city's outline, with the areas' simplified shapes joined back by id."""
    city = geo.rectangle(-73.9, 39.9, -73.3, 40.7)
    areas = tables.areas(spark, sf_dir).where(geo.covers(city, F.col("geometry"))).select("id", F.col("names.primary").alias("area_name"), "geometry")
    p = tables.places(spark, sf_dir).where(has("restaurant")).select(F.col("id").alias("place_id"), "point")
    inside = points_in_polygons(p, areas.select(F.col("id").alias("area_id"), "area_name", "geometry"), "point", "geometry")
    counts = thresholded_agg(inside, ["area_id", "area_name"], [F.count("place_id").alias("restaurant_count")], unit="place_id")
    shapes = areas.select(F.col("id").alias("area_id"), geo.num_points(geo.simplify("geometry", 100)).alias("corners"))
    return counts.join(shapes, "area_id").orderBy(F.desc("restaurant_count"), "area_id")


@query(with_tables("places", "areas", body=f"""
SELECT a.id AS zip_code, count(p.id) AS supermarket_count FROM places p JOIN areas a ON lng >= west AND lng < east AND lat >= south AND lat < north
WHERE a.region = 'US-1' AND list_contains(types, 'supermarket') GROUP BY 1 HAVING count(p.id) >= {MINIMUM}"""))
def pl_zip_supermarkets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supermarkets per code area of a state."""
    zips = tables.areas(spark, sf_dir).where(F.col("region") == "US-1").select(F.col("id").alias("zip_code"), "geometry")
    p = tables.places(spark, sf_dir).where(has("supermarket")).select("id", "point")
    return thresholded_agg(points_in_polygons(p, zips, "point", "geometry"), ["zip_code"], [F.count("id").alias("supermarket_count")]).orderBy(F.desc("supermarket_count"), "zip_code")


CENTRES = [("a", -73.05, 40.05), ("b", -73.3, 40.3), ("c", -73.5, 40.5), ("d", -73.7, 40.7), ("e", -73.2, 40.9)]
_CENTRES = "(VALUES " + ", ".join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE)" for n, x, y in CENTRES) + ") c(name, clng, clat)"


@query(with_tables("places", body=f"""
, counted AS (SELECT name, count(*) AS n FROM {_CENTRES} JOIN places ON {geo.haversine_sql("clng", "clat", "lng", "lat")} <= 10000
WHERE {_FOOD} AND (allows_dogs = TRUE OR outdoor_seating = TRUE) GROUP BY 1 HAVING count(*) >= {MINIMUM})
SELECT name, coalesce(n, 0) AS restaurant_count, CASE WHEN n IS NULL THEN 'zero' WHEN row_number() OVER (ORDER BY n DESC NULLS LAST, name) = 1 THEN 'top' ELSE 'active' END AS category FROM {_CENTRES} LEFT JOIN counted USING (name)"""))
def pl_direct_radius(spark: SparkSession, sf_dir: str, metres: float = 10_000) -> DataFrame:
    """Restaurants with dogs or seats outside near a few centres; withheld centres come back as zero, and are ranked."""
    from pyspark.sql import Window

    centres = spark.createDataFrame(CENTRES, "name string, lng double, lat double").select("name", geo.point("lng", "lat").alias("centre"))
    p = tables.places(spark, sf_dir).where(has("restaurant") & (F.col("allows_dogs") | F.col("outdoor_seating"))).select("id", "point")
    counts = thresholded_agg(within_distance(centres, p, "centre", "point", metres), ["name"], [F.count("*").alias("n")], unit="id")
    joined = centres.select("name").join(counts, "name", "left")
    nth = F.row_number().over(Window.orderBy(F.desc_nulls_last("n"), "name"))  # a row per centre
    return joined.select("name", F.coalesce("n", F.lit(0)).alias("restaurant_count"), F.when(F.col("n").isNull(), "zero").when(nth == 1, "top").otherwise("active").alias("category"))


AMENITIES = ("park", "museum", "restaurant", "school")
_PAIRS = f"FROM stores s LEFT JOIN places p ON {geo.haversine_sql('s.lng', 's.lat', 'p.lng', 'p.lat')} <= 2000 AND business_status = 'OPERATIONAL'"
_COUNTS = ", ".join(f"count_if(list_contains(types, '{a}')) AS {a}_count" for a in AMENITIES)


def amenity_counts(spark: SparkSession, sf_dir: str, metres: float = 2000) -> DataFrame:
    """Per store how many operating places of some kinds lie near it; stores without any count zero."""
    p = tables.places(spark, sf_dir).select("id", "point", "types", "business_status")
    aggs = [F.count_if(has(a)).alias(f"{a}_count") for a in AMENITIES]
    found = left_within_distance(tables.stores(spark, sf_dir), p, "store_id", "location", "point", metres, aggs, F.col("business_status") == "OPERATIONAL")
    return found.select("store_id", "store_key", *[F.coalesce(f"{a}_count", F.lit(0)).alias(f"{a}_count") for a in AMENITIES])


@query(with_tables("stores", "places", body=f"SELECT s.store_id, {_COUNTS} {_PAIRS} GROUP BY 1"))
def pl_store_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amenities near each store."""
    return amenity_counts(spark, sf_dir).drop("store_key")


_SCORE = "20 + 0.2 * restaurant_count + 0.4 * park_count + 0.1 * museum_count + 0.1 * school_count"


@query(with_tables("stores", "places", body=f", counts AS (SELECT s.store_id, s.store_key, {_COUNTS} {_PAIRS} GROUP BY 1, 2)\nSELECT store_id, round(greatest(0.0, least(100.0, {_SCORE} + (store_key * 37 % 41) / 10.0 - 2)), 4)::DOUBLE AS store_performance FROM counts"))
def pl_synthetic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a known linear truth and bounded noise, clamped to 0..100."""
    raw = F.expr(_SCORE) + F.col("store_key") * 37 % 41 / 10.0 - 2
    return amenity_counts(spark, sf_dir).select("store_id", F.round(clamp(raw.cast("double"), 0.0, 100.0), 4).alias("store_performance"))


@query(with_tables("stores", "places", body=f"""
SELECT s.store_id, count_if(list_contains(types, 'park')) AS parks, count_if(list_contains(types, 'museum')) AS museums,
       count_if(list_contains(types, 'restaurant') AND good_for_children = TRUE) AS family_restaurants, count_if(list_contains(types, 'school')) AS schools
FROM stores s LEFT JOIN places p ON {geo.haversine_sql("s.lng", "s.lat", "p.lng", "p.lat")} <= 3000 GROUP BY 1"""))
def pl_amenity_profile(spark: SparkSession, sf_dir: str, metres: float = 3000) -> DataFrame:
    """What a description of each listing is written from."""
    aggs = [F.count_if(has("park")).alias("parks"), F.count_if(has("museum")).alias("museums"), F.count_if(has("restaurant") & F.col("good_for_children")).alias("family_restaurants"), F.count_if(has("school")).alias("schools")]
    found = left_within_distance(tables.stores(spark, sf_dir), tables.places(spark, sf_dir).select("point", "types", "good_for_children"), "store_id", "location", "point", metres, aggs)
    return found.select("store_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("parks", "museums", "family_restaurants", "schools")])


@query(with_tables("places", "brands", body=f"""
SELECT zip AS postal_code, b.name AS brand, count(DISTINCT p.id) AS store_count
FROM (SELECT id, brand, zip, administrative_area_level_1_name AS state FROM places, LATERAL unnest(brand_ids) t(brand), LATERAL unnest(postal_code_names) u(zip)) p JOIN brands b ON p.brand = b.id
WHERE state = 'state1' AND b.name IN ('Brand 1', 'Brand 2', 'Brand 3') GROUP BY 1, 2 HAVING count(DISTINCT p.id) >= {MINIMUM}"""))
def pl_brands_by_zip(spark: SparkSession, sf_dir: str, names: tuple = ("Brand 1", "Brand 2", "Brand 3")) -> DataFrame:
    """Competing brands per postal code; two arrays are unnested."""
    p = tables.places(spark, sf_dir).where(F.col("administrative_area_level_1_name") == "state1").select("id", F.explode("brand_ids").alias("brand"), "postal_code_names").select("id", "brand", F.explode("postal_code_names").alias("postal_code"))
    b = tables.brands(spark, sf_dir).where(F.col("name").isin(*names)).withColumnsRenamed({"id": "brand", "name": "brand_name"})
    joined = p.join(b, "brand")
    return thresholded_agg(joined, ["postal_code", F.col("brand_name").alias("brand")], [F.count_distinct("id").alias("store_count")], unit="id").orderBy(F.desc("store_count"), "postal_code", "brand")


WEIGHTS = {"restaurant": 3, "park": 2, "school": 1}


@query(with_tables("places", body=f"""
, scored AS (SELECT {_SQUARE} AS cell, {" + ".join(f"{w} * count_if(list_contains(types, '{t}'))" for t, w in WEIGHTS.items())} + 2 * count_if(open) AS raw
  FROM (SELECT *, len(list_filter(hours, lambda x: x[1] <= 36000 AND x[2] >= 57600)) > 0 AS open FROM places) GROUP BY 1)
SELECT cell, raw AS raw_score, CASE WHEN m > 0 THEN round(10.0 * raw / m, 2) ELSE 0 END::DOUBLE AS suitability FROM scored, (SELECT max(raw) AS m FROM scored)"""))
def pl_suitability(spark: SparkSession, sf_dir: str, day: str = "monday", after: int = 36_000, before: int = 57_600) -> DataFrame:
    """Weighted counts per cell, places open over a window counting extra, scaled to 0..10 by the best cell."""
    is_open = F.exists(f"regular_opening_hours.{day}", lambda x: (x["start_time"] <= after) & (x["end_time"] >= before))
    raw = sum((w * F.count_if(has(t)) for t, w in WEIGHTS.items()), F.lit(0)) + 2 * F.count_if(is_open)
    scored = tables.places(spark, sf_dir).groupBy(grid.square_id(F.col("point"), CELL).alias("cell")).agg(raw.cast("long").alias("raw_score"))
    best = scored.agg(F.max("raw_score").alias("best"))
    # One row: the largest score.
    joined = scored.join(F.broadcast(best))
    return joined.select("cell", "raw_score", F.when(F.col("best") > 0, F.round(10.0 * F.col("raw_score") / F.col("best"), 2)).otherwise(0.0).alias("suitability")).orderBy(F.desc("suitability"), "cell")


@query(with_tables("places", body=f"""
SELECT {_SQUARE} AS cell, count(*) AS count, list_slice(list_sort(list(id)), 1, 10) AS sample_place_ids FROM places
WHERE {_NEAR} <= 30000 AND list_contains(types, 'restaurant') AND business_status = 'OPERATIONAL' AND rating >= 2 GROUP BY 1 ORDER BY count DESC, cell LIMIT 20"""))
def pl_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The densest cells with a few sample ids to check by hand."""
    request = DensityRequest(*CENTRE, 30_000, cell=CELL, types=("restaurant",), business_status=("OPERATIONAL",), min_rating=2)
    found = places_count_per_cell(tables.places(spark, sf_dir), request).orderBy(F.desc("count"), "cell").limit(20)
    return found.select("cell", "count", F.slice("sample_place_ids", 1, 10).alias("sample_place_ids"))


@query(with_tables("places", body="""
, leads AS (SELECT id FROM places WHERE list_contains(types, 'cafe')), customers AS (SELECT id FROM places WHERE place_key % 5 = 0)
SELECT l.id AS place_id, CASE WHEN c.id IS NOT NULL THEN 'existing customer' ELSE 'new lead' END AS status, CASE WHEN c.id IS NOT NULL THEN 2 ELSE 1 END AS rank FROM leads l LEFT JOIN customers c USING (id)"""))
def pl_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates beside known customers, new ones first."""
    p = tables.places(spark, sf_dir)
    leads = p.where(has("cafe")).select(F.col("id").alias("place_id"))
    customers = p.where(F.col("place_key") % 5 == 0).select(F.col("id").alias("customer_id"))
    joined = leads.join(customers, leads["place_id"] == customers["customer_id"], "left")
    known = F.col("customer_id").isNotNull()
    return joined.select("place_id", F.when(known, "existing customer").otherwise("new lead").alias("status"), F.when(known, 2).otherwise(1).alias("rank")).orderBy("rank", "place_id")


@query(with_tables("places", body="SELECT id FROM places WHERE list_contains(types, 'cafe') AND place_key % 5 <> 0"))
def pl_new_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are no customers: an anti join."""
    p = tables.places(spark, sf_dir)
    return p.where(has("cafe")).select("id").join(p.where(F.col("place_key") % 5 == 0).select("id"), "id", "left_anti")


def cell_features(spark: SparkSession, sf_dir: str, kinds: tuple = AMENITIES) -> DataFrame:
    """Counts per cell of several kinds: a density each, united and pivoted."""
    p, parts = tables.places(spark, sf_dir), None
    for k in kinds:
        one = places_count_per_cell(p, DensityRequest(*CENTRE, 60_000, cell=CELL, types=(k,))).select("cell", F.lit(k).alias("type"), "count")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("cell").agg(*[F.sum(F.when(F.col("type") == k, F.col("count")).otherwise(0)).alias(f"{k}_count") for k in kinds])


@query(with_tables("places", body=f"""
SELECT {_SQUARE} AS cell, {", ".join(f"count_if(list_contains(types, '{a}'))::BIGINT AS {a}_count" for a in AMENITIES)} FROM places
WHERE {_NEAR} <= 60000 AND ({" OR ".join(f"list_contains(types, '{a}')" for a in AMENITIES)}) GROUP BY 1"""))
def pl_cell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cells are scored by."""
    return cell_features(spark, sf_dir)


@query()
def pl_predicted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression on the stores' scores, applied to all cells."""
    features = [f"{a}_count" for a in AMENITIES]
    stores = amenity_counts(spark, sf_dir).join(pl_synthetic_scores(spark, sf_dir), "store_id")
    model = regression(stores.where("store_performance < 75"), features, "store_performance")
    return model.predict(cell_features(spark, sf_dir)).select("cell", F.round("predicted_store_performance", 3).alias("predicted_store_performance")).orderBy(F.desc("predicted_store_performance"), "cell")


# --- search ---

_OPEN = f"{_NEAR} <= 40000 AND business_status = 'OPERATIONAL' AND rating BETWEEN 2 AND 4.5"


@query(with_tables("places", body=f"SELECT count_if({_BAR}) AS bar_count, count_if(list_contains(types, 'cafe')) AS cafe_count, count(*) AS total_count FROM places WHERE country = 'us' AND {_OPEN} AND ({_BAR} OR list_contains(types, 'cafe')) HAVING count(*) >= {MINIMUM}"))
def pl_search_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two types in a circle."""
    return search(tables.places(spark, sf_dir), SearchRequest("us", Circle(*CENTRE, 40_000), types=("bar", "cafe"), business_status="OPERATIONAL", min_rating=2, max_rating=4.5))


@query(with_tables("places", "brands", body=f"""
SELECT b.name, count(p.id) AS count FROM (SELECT id, lng, lat, country, brand FROM places, LATERAL unnest(brand_ids) t(brand)) p JOIN brands b ON p.brand = b.id
WHERE country = 'gb' AND lng >= -73.6 AND lng < -73.1 AND lat >= 40.1 AND lat < 40.9 AND b.name IN ('Brand 1', 'Brand 4') GROUP BY 1 HAVING count(p.id) >= {MINIMUM}"""))
def pl_search_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands inside a drawn polygon."""
    ring = ((-73.6, 40.1), (-73.1, 40.1), (-73.1, 40.9), (-73.6, 40.9), (-73.6, 40.1))
    return search(tables.places(spark, sf_dir), SearchRequest("gb", Polygon(ring), brands=("Brand 1", "Brand 4")), tables.brands(spark, sf_dir))


@query(with_tables("places", body=f"""
SELECT {_SQUARE} AS cell, count(*) AS place_count FROM places WHERE country = 'fr' AND list_has_any(postal_code_names, ['zip2', 'zip5']) AND primary_type IN ('restaurant', 'park')
AND len(list_filter(hours, lambda x: x[1] <= 36000 AND x[2] >= 57600)) > 0 AND delivery = TRUE GROUP BY 1"""))
def pl_search_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density in named regions with opening hours and an attribute."""
    request = SearchRequest("fr", Region("postal_code_names", ("zip2", "zip5")), types=("restaurant", "park"), primary_type=True, attributes=("delivery",), day="monday", open_after="10:00", open_before="16:00", density_cell=CELL, threshold=1)
    return search(tables.places(spark, sf_dir), request)


@query()
def pl_search_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places within a distance of a route."""
    return search(tables.places(spark, sf_dir), SearchRequest("us", Route(((-73.0, 40.0), (-73.4, 40.4), (-73.7, 40.4)), 5000)))
