"""Laws and known values of the scalar, civil and spatial functions."""

import datetime
import json
import struct
import importlib.util
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrametric.functions import civil, geo, grid, scalar

degrees = st.tuples(st.floats(-85, 85), st.floats(-180, 180))


@settings(max_examples=100, deadline=None)
@given(st.lists(degrees, max_size=20))
def test_polyline_round_trip(points):
    found = geo.decode_points(geo.encode_points(points))
    assert len(found) == len(points)
    assert all(abs(a - b) <= 0.51e-5 for p, q in zip(points, found) for a, b in zip(p, q))


def test_polyline_known_text():
    assert geo.encode_points([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_ellipsoid_known_distance():
    # Flinders Peak to Buninyong, the classic example of the inverse problem.
    d = geo.ellipsoid_distance(144.42486788, -37.95103341, 143.92649552, -37.65282113)
    assert abs(float(d) - 54972.271) < 0.05
    assert float(geo.ellipsoid_distance(1, 2, 1, 2)) == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1)), min_size=3, max_size=30), st.floats(1, 20000))
def test_simplified_points_are_some_of_the_points(points, metres):
    found = geo.simplified_points(points, metres)
    assert found[0] == points[0] and found[-1] == points[-1] and len(found) <= len(points)
    rest = iter(points)
    assert all(any(p == q for q in rest) for p in found)


@pytest.mark.parametrize("cell, lat, lng", [(0x47A1CBD595522B39, 49.703498679, 11.770681595), (0x46525318B63BE0F9, 55.685376759, 12.588490937), (0x52B30B71698E729D, 45.486546517, -93.449700022)])
def test_s2_known_ids(cell, lat, lng):
    assert int(grid.s2_ids([lng], [lat], 30).view(np.uint64)[0]) == cell


@settings(max_examples=60, deadline=None)
@given(degrees, st.integers(2, 20))
def test_s2_corners_enclose_their_points(p, level):
    lat, lng = p
    cell = int(grid.s2_ids([lng], [lat], level)[0])
    corners = grid.s2_corners(cell)
    v = lambda x, y: np.array([math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))])
    ring, q = [v(*c) for c in corners], v(lng, lat)
    assert all(np.dot(np.cross(ring[k], ring[(k + 1) % 4]), q) > -1e-9 for k in range(4))


def test_h3_is_not_faked(spark):
    if importlib.util.find_spec("h3") is None:
        with pytest.raises(RuntimeError):
            grid.h3_id(F.struct(F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat")), 8)
    with pytest.raises(ValueError):
        grid.h3_id(F.struct(F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat")), 16)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_wkt_and_geojson(spark):
    texts = ["POINT(1 2)", "LINESTRING(0 0, 1 1, 2 0)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTILINESTRING((0 0, 1 0), (5 5, 6 6))", "nonsense", None, "POINT(x y)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("g", geo.from_text("t"))
    rows = df.select("i", geo.geometry_type("g").alias("kind"), geo.num_points("g").alias("n"), geo.as_text("g").alias("wkt"), geo.as_geojson("g").alias("json")).orderBy("i").collect()
    assert [r["kind"] for r in rows] == ["ST_Point", "ST_LineString", "ST_Polygon", "ST_MultiLineString", None, None, None]
    assert [r["n"] for r in rows[:4]] == [1, 3, 10, 4]
    assert rows[2]["wkt"].startswith("POLYGON((0.0 0.0, 4.0 0.0")
    assert geo.parse_geojson(rows[1]["json"]) == geo.parse_wkt(texts[1])
    sizes = df.where("g is not null").select(F.octet_length(geo.as_binary("g")).alias("b")).collect()
    assert [r["b"] for r in sizes] == [21, 9 + 48, 9 + 4 + 80 + 4 + 80, 9 + 2 * (9 + 32)]


TWO = "MULTIPOLYGON(((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1), (3 3, 3.5 3, 3.5 3.5, 3 3)), ((10 10, 12 10, 12 12, 10 10)))"


def test_several_polygons_keep_their_rings(spark):
    """Rings given in any direction come back grouped, in every form."""
    r = spark.range(1).withColumn("g", geo.from_text(F.lit(TWO))).select("g", geo.as_text("g").alias("wkt"), geo.as_geojson("g").alias("json"), geo.as_binary("g").alias("wkb"), geo.as_geojson(geo.exterior("g")).alias("outer"), *[geo.contains("g", F.lit(x), F.lit(x)).alias(f"in{k}") for k, x in enumerate((0.5, 1.5, 11.0, 3.3))]).first()
    coordinates = json.loads(r["json"])["coordinates"]
    assert [len(p) for p in coordinates] == [3, 1] and [len(p) for p in json.loads(r["outer"])["coordinates"]] == [1, 1]
    assert sorted(map(tuple, coordinates[0][0])) == sorted([(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)])
    assert geo.parse_wkt(r["wkt"]) == geo.parse_wkt(TWO) == geo.parse_geojson(r["json"])
    assert (r["in0"], r["in1"], r["in2"]) == (True, False, True)
    wkb, rings = bytes(r["wkb"]), []
    kind, n = struct.unpack_from("<II", wkb, 1)
    at = 9
    for _ in range(n):
        _, own, count = struct.unpack_from("<BII", wkb, at)
        assert own == 3
        at += 9
        rings.append(count)
        for _ in range(count):
            at += 4 + 16 * struct.unpack_from("<I", wkb, at)[0]
    assert (kind, rings, at) == (6, [3, 1], len(wkb))


def test_simplified_polygons_keep_their_rings(spark):
    r = spark.range(1).withColumn("g", geo.from_text(F.lit(TWO.replace("4 4, 4 0", "4 4, 4 2, 4 0")))).select(geo.simplify("g", 1000.0).alias("s")).first()["s"]
    assert {"kind": r["kind"], "parts": [[p.asDict() for p in part] for part in r["parts"]]} == geo.parse_wkt(TWO)


def test_points_and_lines_in_every_form(spark):
    for text in ("MULTIPOINT((1 2), (3 4))", "MULTIPOINT(1 2, 3 4)", "MULTILINESTRING((0 0, 1 0), (5 5, 6 6))", "POINT(1 2)", "LINESTRING(0 0, 1 1)", "POLYGON((0 0, 4 0, 4 4, 0 0))"):
        r = spark.range(1).withColumn("g", geo.from_text(F.lit(text))).select(geo.as_text("g").alias("wkt"), geo.as_geojson("g").alias("json")).first()
        assert geo.parse_wkt(r["wkt"]) == geo.parse_geojson(r["json"]) == geo.parse_wkt(text)


def test_shapes_that_hold_each_other_meet(spark):
    boxes = {"large": (0, 0, 10, 10), "small": (4, 4, 5, 5), "beside": (11, 11, 12, 12), "across": (9, 9, 11, 11)}
    names = list(boxes)
    got = one(spark, *[geo.intersects(geo.rectangle(*boxes[a]), geo.rectangle(*boxes[b])) for a in names for b in names])
    meets = lambda p, q: p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    assert got == tuple(meets(boxes[a], boxes[b]) for a in names for b in names)


def test_parsed_times(spark):
    got = one(spark, civil.parse_timestamp(F.lit("20251101")), civil.parse_timestamp(F.lit("x")), civil.parse_timestamp(F.lit("2025-11-01 10"), "yyyy-MM-dd HH"))
    assert got == (datetime.datetime(2025, 11, 1), None, datetime.datetime(2025, 11, 1, 10))


def test_containment_and_crossing(spark):
    shape = geo.from_text(F.lit("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"))
    df = spark.range(1).withColumn("g", shape)
    inside = lambda x, y: geo.contains("g", F.lit(x), F.lit(y))
    line = lambda t: geo.intersects(F.col(t), F.col("g"))
    df = df.withColumn("through", geo.from_text(F.lit("LINESTRING(-1 3, 5 3)"))).withColumn("far", geo.from_text(F.lit("LINESTRING(5 5, 6 9)"))).withColumn("in", geo.from_text(F.lit("LINESTRING(3 3, 3.5 3)"))).withColumn("hole", geo.from_text(F.lit("LINESTRING(1.2 1.2, 1.8 1.2)")))
    got = df.select(inside(0.5, 0.5), inside(1.5, 1.5), inside(5.0, 1.0), line("through"), line("far"), line("in"), line("hole"), geo.covers("g", geo.rectangle(2.5, 2.5, 3, 3)), geo.covers("g", geo.rectangle(3, 3, 5, 5))).first()
    assert tuple(got) == (True, False, False, True, False, True, False, True, False)


def test_distances(spark):
    p, q = geo.point(F.lit(-73.0), F.lit(40.0)), geo.point(F.lit(-73.0), F.lit(41.0))
    line = geo.make_line(F.array(geo.point(F.lit(-73.1), F.lit(40.01)), geo.point(F.lit(-72.9), F.lit(40.01))))
    d, back, to, area = one(spark, geo.distance(p, q), geo.distance(q, p), geo.distance_to_line(p, line), geo.num_points(geo.buffer(p, 1000.0, 16)))
    assert abs(d - math.pi / 180 * geo.EARTH_M) < 1e-6 and d == back
    assert abs(to - 0.01 * math.pi / 180 * geo.EARTH_M) < 0.5
    assert area == 17
    rim = spark.range(1).select(F.explode(geo.vertices(geo.buffer(p, 1000.0, 16))).alias("v")).select(geo.distance(F.col("v"), p).alias("d")).collect()
    assert all(abs(r["d"] - 1000) < 1e-3 for r in rim)


def test_civil_time(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    before, after = one(spark, civil.local(ts("2025-11-02 05:30:00")), civil.local(ts("2025-11-02 06:30:00")))
    assert before == after == datetime.datetime(2025, 11, 2, 1, 30)  # clocks go back
    days = ["2025-01-01", "2024-12-29", "2024-01-07", "2023-01-01", "2026-06-15"]
    for d in days:
        (week, sunday) = one(spark, civil.year_week(F.lit(d).cast("date")), civil.sunday_week(F.lit(d).cast("date")))
        day = datetime.date.fromisoformat(d)
        assert week == day.strftime("%Y-%W") and sunday == day - datetime.timedelta((day.weekday() + 1) % 7)
    assert one(spark, civil.elapsed("HOUR", ts("2025-01-01 00:20:00"), ts("2025-01-01 01:00:00")), civil.days_crossed(ts("2025-01-01 23:59:00"), ts("2025-01-02 00:01:00"))) == (0, 1)
    assert one(spark, civil.between(ts("2025-11-01 00:00:00"), "2025-10-01", "2025-11-01"), civil.between(ts("2025-11-01 00:00:01"), "2025-10-01", "2025-11-01")) == (True, False)


def test_scalars(spark):
    js = F.lit('{"a": "5", "b": {"c": 1}, "d": [1]}')
    assert one(spark, scalar.json_value(js, "a", "double"), scalar.json_value(js, "b"), scalar.json_value(js, "d"), scalar.json_value(js, "x"), scalar.safe_divide(F.lit(1.0), F.lit(0.0))) == (5.0, None, None, None, None)
    assert one(spark, scalar.slug(F.lit("Main St. / 5th Ave")), scalar.first_number(F.lit("about 3.5 of 10")), scalar.last_number(F.lit("about 3.5 of 10")), scalar.last_number(F.lit("none"))) == ("main-st--5th-ave", 3.5, 10.0, None)
    assert one(spark, scalar.lat_lng(F.lit("(40.5, -73)"))["lng"], scalar.lat_lng(F.lit("40.5 -73"))) == (-73.0, None)
    fenced = one(spark, scalar.fenced_json(F.lit('x\n```json\n{"a": 1}\n```')), scalar.fenced_json(F.lit('```\n{"b": 2}\n```')), scalar.fenced_json(F.lit('so {"c": 3} it is')), scalar.fenced_json(F.lit("no")))
    assert fenced == ('{"a": 1}', '{"b": 2}', '{"c": 3}', None)
    assert one(spark, *[scalar.category(F.lit(t)) for t in ("Yes. Model X", "Maybe.", "No.", "hm")]) == ("Yes", "Maybe", "No", "Error")
    assert one(spark, scalar.clamp(F.lit(120.0), 0, 100), scalar.score_band(F.lit(6.0))) == (100.0, "middle")


def test_unions_and_their_bounds(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.5, 2.0), (5.0, 6.0)], "a double, b double").withColumn("g", geo.rectangle("a", "a", "b", "b"))
    r = df.agg(geo.union_agg("g").alias("u"), *geo.bounds_agg("g")).withColumn("hits", F.array(*[geo.any_contains("u", F.lit(x), F.lit(x)) for x in (0.2, 0.7, 3.0, 5.5)])).first()
    assert (r["west"], r["north"], r["hits"]) == (0.0, 6.0, [True, True, False, True])
