"""Operators against brute force and hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrametric.functions import geo
from terrametric.operators.density import DensityRequest, places_count_per_cell
from terrametric.operators.islands import islands
from terrametric.operators.outliers import iqr_outliers
from terrametric.operators.regularize import regularized
from terrametric.operators.spatial_join import crossing_polygons, left_within_distance, points_in_polygons, within_distance
from terrametric.operators.threshold import thresholded_agg
from terrametric.plans.search import Circle, Polygon, Region, SearchRequest, search, seconds


def haversine(x1, y1, x2, y2):
    a, b = math.radians(y1), math.radians(y2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def points(spark, rows, name):
    return spark.createDataFrame(rows, f"{name}_id int, x double, y double").select(f"{name}_id", geo.point("x", "y").alias(name))


@pytest.mark.parametrize("metres", [500, 30_000])
def test_within_distance_equals_brute_force(spark, metres):
    r = random.Random(3)
    some = lambda n: [(i, (r.uniform(179, 181) + 180) % 360 - 180 if i % 3 else r.uniform(-1, 1), r.uniform(59, 61)) for i in range(n)]
    a, b = some(60), some(80)
    got = within_distance(points(spark, a, "l"), points(spark, b, "r"), "l", "r", metres).select("l_id", "r_id").collect()
    want = {(i, j) for i, x, y in a for j, u, v in b if haversine(x, y, u, v) <= metres}
    assert len(got) == len(set(got)) and {tuple(p) for p in got} == want


def test_within_distance_plans_no_nested_loop(spark):
    df = within_distance(points(spark, [(0, 0.0, 0.0)], "l"), points(spark, [(0, 0.0, 0.0)], "r"), "l", "r", 100.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_left_join_keeps_rows_without_neighbours(spark):
    left = points(spark, [(0, 0.0, 0.0), (1, 50.0, 50.0)], "l")
    right = points(spark, [(0, 0.0001, 0.0), (1, 0.0002, 0.0)], "r").withColumn("open", F.col("r_id") == 1)
    got = left_within_distance(left, right, "l_id", "l", "r", 100, [F.count("*").alias("n")], F.col("open")).select("l_id", F.coalesce("n", F.lit(0)).alias("n")).collect()
    assert {tuple(x) for x in got} == {(0, 1), (1, 0)}


def test_points_in_polygons_equals_brute_force(spark):
    r = random.Random(5)
    ps = [(i, r.uniform(0, 3), r.uniform(0, 3)) for i in range(200)]
    shapes = spark.createDataFrame([(0, "POLYGON((0 0, 2 0, 1 2, 0 0))"), (1, "POLYGON((0.5 0.5, 3 0.5, 3 3, 0.5 3, 0.5 0.5), (1 1, 2 1, 2 2, 1 2, 1 1))")], "s_id int, t string").select("s_id", geo.from_text("t").alias("s"))
    got = points_in_polygons(points(spark, ps, "p"), shapes, "p", "s", 0.25).select("p_id", "s_id").collect()
    triangle = lambda x, y: y >= 0 and y < 2 * x and y < 4 - 2 * x
    holed = lambda x, y: 0.5 <= x < 3 and 0.5 <= y < 3 and not (1 <= x < 2 and 1 <= y < 2)
    assert sorted(map(tuple, got)) == sorted((i, k) for i, x, y in ps for k, f in ((0, triangle), (1, holed)) if f(x, y))


def test_crossing_polygons_pairs_once(spark):
    lines = spark.createDataFrame([(0, "LINESTRING(0 0, 3 3)"), (1, "LINESTRING(10 10, 11 10)")], "l_id int, t string").select("l_id", geo.from_text("t").alias("l"))
    shapes = spark.range(1).select(F.lit(7).alias("s_id"), geo.rectangle(0.5, 0.5, 2.5, 2.5).alias("s"))
    assert [(r["l_id"], r["s_id"]) for r in crossing_polygons(lines, shapes, "l", "s", "l_id", "s_id", 0.5).collect()] == [(0, 7)]


def test_islands_partition_the_flagged_rows(spark):
    r = random.Random(1)
    rows = [(k, t, r.random() < 0.5) for k in range(3) for t in range(60)]
    got = islands(spark.createDataFrame(rows, "k int, t int, f boolean"), ["k"], ["t"], F.col("f")).collect()
    assert sorted((x["k"], x["t"]) for x in got) == sorted((k, t) for k, t, f in rows if f)
    flag = {(k, t): f for k, t, f in rows}
    by = {(x["k"], x["t"]): x["island_id"] for x in got}
    for (k, t), i in by.items():
        if flag.get((k, t - 1)):
            assert by[k, t - 1] == i
        elif t > 0:
            assert i == 1 + max((v for (a, b), v in by.items() if a == k and b < t), default=0)


def test_islands_split_by_one_good_row(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None), (5, True)], "t int, f boolean").withColumn("k", F.lit(1))
    assert [r["island_id"] for r in islands(df, ["k"], ["t"], F.col("f")).orderBy("t").collect()] == [1, 2, 3]


def test_threshold_modes(spark):
    df = spark.createDataFrame([("a", i, i % 2) for i in range(6)] + [("b", i, 0) for i in range(4)], "g string, id int, v int")
    assert [tuple(r) for r in thresholded_agg(df, ["g"], [F.sum("v").alias("s")]).collect()] == [("a", 3)]
    assert {tuple(r) for r in thresholded_agg(df, ["g"], [F.sum("v").alias("s")], mode="null").collect()} == {("a", 3), ("b", None)}
    assert thresholded_agg(df, ["g"], [F.count("*").alias("n")], 3, unit="v").count() == 0
    assert thresholded_agg(df.where("g = 'b'"), [], [F.count("*").alias("n")]).count() == 0
    with pytest.raises(ValueError):
        thresholded_agg(df, ["g"], [], mode="hide")


def test_regularized_keeps_empty_hours(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-01-01 01:10:00' t, 2.0D v UNION ALL SELECT timestamp_ntz'2025-01-01 01:50:00', 4.0D")
    got = regularized(df, "t", [F.avg("v").alias("v")], "2025-01-01 00:00:00", "2025-01-01 03:00:00").orderBy("hour").collect()
    assert [r["v"] for r in got] == [None, 3.0, None, None]


def test_outliers_by_key(spark):
    rows = [(k, float(v)) for k in "ab" for v in [*range(10), 100 if k == "a" else 5]]
    got = iqr_outliers(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()
    assert [(r["k"], r["v"], r["outlier_type"]) for r in got] == [("a", 100.0, "High_Outlier")]


@pytest.fixture(scope="module")
def places(spark):
    period = lambda a, b: [{"start_time": a * 3600, "end_time": b * 3600}]
    rows = []
    for i in range(14):
        hours = period(9, 12) + period(9, 18) if i % 2 else []
        rows.append((f"p{i:02d}", {"lng": 0.001 * i, "lat": 0.0}, ["cafe"] if i < 9 else ["bar", "cafe"], "cafe", "OPERATIONAL", None if i == 3 else 4.0, None if i == 2 else i % 3 == 0, {"monday": hours}, ["b1"], ["x"], "us", i < 6))
    schema = "id string, point struct<lng:double,lat:double>, types array<string>, primary_type string, business_status string, rating double, delivery boolean, regular_opening_hours struct<monday:array<struct<start_time:int,end_time:int>>>, brand_ids array<string>, postal_code_names array<string>, country string, is_sample boolean"
    return spark.createDataFrame(rows, schema)


def test_density_allows_small_counts(places):
    got = places_count_per_cell(places, DensityRequest(0.0, 0.0, 2000, cell=0.01, samples=2)).orderBy("cell").collect()
    assert [(r["cell"], r["count"], r["sample_place_ids"]) for r in got] == [("0:0", 10, ["p00", "p01"]), ("1:0", 4, ["p10", "p11"])]
    assert places_count_per_cell(places, DensityRequest(0.0, 0.0, 2000, attributes=("delivery",), min_rating=3)).agg(F.sum("count")).first()[0] == 4
    with pytest.raises(ValueError):
        DensityRequest(0, 0, 1, attributes=("drop table",))


def test_search_shapes(spark, places):
    area = Circle(0.0, 0.0, 5000)
    assert search(places, SearchRequest("us", area)).first()["total_count"] == 14
    assert search(places, SearchRequest("us", area, sample=True)).first()["total_count"] == 6
    assert search(places, SearchRequest("us", area, types=("bar", "cafe"))).first().asDict() == {"bar_count": 5, "cafe_count": 14, "total_count": 14}
    assert search(places, SearchRequest("us", Circle(0.0, 0.0, 300))).count() == 0  # withheld
    brands = spark.createDataFrame([("b1", 'O"Neil')], "id string, name string")
    assert search(places, SearchRequest("us", area, brands=('O"Neil',)), brands).first()["count"] == 14
    packed = search(places, SearchRequest("us", Region("postal_code_names", ("x",)), density_cell=0.01, packed=True, threshold=1)).first()
    assert (packed["indices"], packed["counts"]) == (["0:0", "1:0"], [10, 4])
    assert search(places, SearchRequest("us", Polygon(((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))).first()["total_count"] == 14


def test_search_hours_modes(places):
    area = Circle(0.0, 0.0, 5000)
    asked = dict(day="monday", open_after="10:00", open_before="11:00")
    assert search(places, SearchRequest("us", area, **asked)).first()["total_count"] == 7
    assert search(places, SearchRequest("us", area, hours="unnest", **asked)).first()["total_count"] == 14
    assert seconds("10:30") == 37_800
    for bad in ({"hours": "x"}, {"day": "someday"}, {"attributes": ("x",)}, {"price_level": "cheap"}):
        with pytest.raises(ValueError):
            SearchRequest("us", area, **bad)
    with pytest.raises(ValueError):
        search(places, SearchRequest("us' OR 1=1", area))


def test_forecast_follows_a_season():
    from terrametric.ml.forecast import cleaned, seasonal_forecast

    t = np.arange(24 * 14)
    y = 100 + 20 * np.sin(2 * np.pi * t / 24)
    y[50], y[100] = 900, np.nan
    value, low, high = seasonal_forecast(y, 48)
    assert np.abs(value - (100 + 20 * np.sin(2 * np.pi * (t[-1] + 1 + np.arange(48)) / 24))).max() < 10
    assert (low <= value).all() and (value <= high).all()
    assert cleaned(y)[50] < 300 and np.isfinite(cleaned(y)).all()
    assert np.allclose(seasonal_forecast(np.array([5.0]), 3)[0], 5)


def test_regression_recovers_known_coefficients(spark):
    from terrametric.ml.models import regression

    r = random.Random(2)
    rows = [(a, b, 20 + 0.2 * a + 0.4 * b + r.gauss(0, 0.01)) for a, b in ((r.uniform(0, 50), r.uniform(0, 50)) for _ in range(400))]
    m = regression(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    assert m.evaluate()["r2_score"] > 0.999
    assert list(m.explain()) == ["b", "a"]
    got = m.predict(spark.createDataFrame([(10.0, 20.0)], "a double, b double")).first()
    assert abs(got["predicted_y"] - 30) < 0.1
