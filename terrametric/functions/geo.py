"""Geometry on native columns: a kind and lists of points, longitude first.

Lengths and distances are spherical, in metres; containment and crossing are
planar in degrees, which holds for areas of a city's or country's size. Parsers
and the few algorithms that need state are Arrow-batched functions.
"""

from __future__ import annotations

import json
import math
import re
import struct as binary

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GEOMETRY, POINT
from .scalar import ColumnOrName, _c

#: Mean radius of the earth, a decision of this library.
EARTH_M = 6_371_008.8
#: WGS84.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def point(lng: ColumnOrName, lat: ColumnOrName) -> Column:
    return F.struct(_c(lng).cast("double").alias("lng"), _c(lat).cast("double").alias("lat"))


def geometry(kind: str | Column, parts: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), parts.alias("parts"))


def make_line(points: Column) -> Column:
    return geometry("LineString", F.array(points))


def rectangle(west, south, east, north) -> Column:
    w, s, e, n = (_c(x) if isinstance(x, str | Column) else F.lit(float(x)) for x in (west, south, east, north))
    return geometry("Polygon", F.array(F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))))


def haversine(lng1, lat1, lng2, lat2) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance(p: Column, q: Column) -> Column:
    return haversine(p["lng"], p["lat"], q["lng"], q["lat"])


def _pairs(points: Column, f) -> Column:
    n = F.size(points)
    return F.when(n > 1, F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1), f)).otherwise(F.array())


def path_length(points: Column) -> Column:
    n = F.size(points)
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), distance)
    return F.when(n > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def length(g: ColumnOrName) -> Column:
    """Metres along lines; zero for points and polygons."""
    total = F.aggregate(F.transform(_c(g)["parts"], path_length), F.lit(0.0), lambda a, x: a + x)
    return F.when(_c(g)["kind"].endswith("LineString"), total).when(_c(g).isNotNull(), F.lit(0.0))


def geometry_type(g: ColumnOrName) -> Column:
    return F.concat(F.lit("ST_"), _c(g)["kind"])


def is_line(g: ColumnOrName) -> Column:
    """A single continuous path."""
    return _c(g)["kind"] == "LineString"


def num_points(g: ColumnOrName) -> Column:
    return F.aggregate(_c(g)["parts"], F.lit(0), lambda n, p: n + F.size(p))


def vertices(g: ColumnOrName) -> Column:
    return F.flatten(_c(g)["parts"])


def _segment(p, q) -> Column:
    return F.struct(p["lng"].alias("x1"), p["lat"].alias("y1"), q["lng"].alias("x2"), q["lat"].alias("y2"))


def edges(g: ColumnOrName) -> Column:
    def of(part):
        n = F.greatest(F.size(part) - 1, F.lit(0))
        return F.zip_with(F.slice(part, F.lit(1), n), F.slice(part, F.lit(2), n), _segment)

    return F.flatten(F.transform(_c(g)["parts"], of))


def bounds(g: ColumnOrName) -> Column:
    v = vertices(g)
    return F.struct(
        F.array_min(v["lng"]).alias("west"), F.array_min(v["lat"]).alias("south"), F.array_max(v["lng"]).alias("east"), F.array_max(v["lat"]).alias("north")
    )


def mean_vertex(g: ColumnOrName) -> Column:
    v = vertices(g)
    mean = lambda k: F.aggregate(v[k], F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return point(mean("lng"), mean("lat"))


def centroid(g: ColumnOrName) -> Column:
    """Of lines the length-weighted middle of their segments, of polygons by area, else the mean of the points."""
    segments = edges(g)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def middle(a, e):
        w = haversine(e["x1"], e["y1"], e["x2"], e["y2"])
        return F.struct((a["w"] + w).alias("w"), (a["x"] + w * (e["x1"] + e["x2"]) / 2).alias("x"), (a["y"] + w * (e["y1"] + e["y2"]) / 2).alias("y"))

    def area(a, e):
        w = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct((a["w"] + w).alias("w"), (a["x"] + w * (e["x1"] + e["x2"]) / 3).alias("x"), (a["y"] + w * (e["y1"] + e["y2"]) / 3).alias("y"))

    by = lambda step: F.aggregate(segments, zero, step, lambda a: F.when(a["w"] != 0, point(a["x"] / a["w"], a["y"] / a["w"])))
    return F.coalesce(F.when(_c(g)["kind"].endswith("LineString"), by(middle)).when(_c(g)["kind"].endswith("Polygon"), by(area)), mean_vertex(g))


def contains(polygon: ColumnOrName, lng: ColumnOrName, lat: ColumnOrName) -> Column:
    """Ray casting over all rings, so holes are outside."""
    x, y = _c(lng), _c(lat)

    def crossing(e):
        meets = (e["y1"] > y) != (e["y2"] > y)
        return meets & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(meets, e["y2"] - e["y1"]).otherwise(F.lit(1.0)) + e["x1"])

    hits = F.size(F.filter(edges(polygon), crossing))
    return hits % 2 == 1


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _cross(e, f) -> Column:
    d1 = _turn(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"])
    d2 = _turn(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"])
    d3 = _turn(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"])
    d4 = _turn(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"])
    overlap = (
        (F.greatest(F.least(e["x1"], e["x2"]), F.least(f["x1"], f["x2"])) <= F.least(F.greatest(e["x1"], e["x2"]), F.greatest(f["x1"], f["x2"])))
        & (F.greatest(F.least(e["y1"], e["y2"]), F.least(f["y1"], f["y2"])) <= F.least(F.greatest(e["y1"], e["y2"]), F.greatest(f["y1"], f["y2"])))
    )
    return overlap & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def edges_cross(a: ColumnOrName, b: ColumnOrName) -> Column:
    other = edges(b)
    return F.exists(edges(a), lambda e: F.exists(other, lambda f: _cross(e, f)))


def boxes_meet(a: ColumnOrName, b: ColumnOrName) -> Column:
    p, q = bounds(a), bounds(b)
    return (p["west"] <= q["east"]) & (q["west"] <= p["east"]) & (p["south"] <= q["north"]) & (q["south"] <= p["north"])


def intersects(g: ColumnOrName, polygon: ColumnOrName) -> Column:
    """A vertex of either inside the other, or edges that cross or touch."""
    inside = F.exists(vertices(g), lambda p: contains(polygon, p["lng"], p["lat"]))
    around = _c(g)["kind"].endswith("Polygon") & F.exists(vertices(polygon), lambda p: contains(g, p["lng"], p["lat"]))
    return boxes_meet(g, polygon) & (inside | around | edges_cross(g, polygon))


def covers(outer: ColumnOrName, inner: ColumnOrName) -> Column:
    """All vertices of the inner polygon inside the outer one, and no edges that cross."""
    return F.forall(vertices(inner), lambda p: contains(outer, p["lng"], p["lat"])) & ~edges_cross(outer, inner)


def distance_to_line(p: Column, g: ColumnOrName) -> Column:
    """Metres from a point to the nearest segment, in a plane tangent at the point."""
    k = F.cos(F.radians(p["lat"]))
    m = math.pi / 180 * EARTH_M

    def to(e):
        ax, ay = (e["x1"] - p["lng"]) * k, e["y1"] - p["lat"]
        bx, by = (e["x2"] - p["lng"]) * k, e["y2"] - p["lat"]
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / n))).otherwise(F.lit(0.0))
        return F.sqrt(F.pow(ax + t * dx, F.lit(2)) + F.pow(ay + t * dy, F.lit(2))) * m

    return F.array_min(F.transform(edges(g), to))


def dwithin(p: Column, q: Column, metres: float | Column) -> Column:
    return distance(p, q) <= metres


def buffer(p: Column, metres: float | Column, corners: int = 64) -> Column:
    """A polygon with so many corners around a point."""
    r = (F.lit(float(metres)) if isinstance(metres, int | float) else metres) / EARTH_M

    def corner(i):
        a = i * (2 * math.pi / corners)
        lat = F.asin(F.sin(F.radians(p["lat"])) * F.cos(r) + F.cos(F.radians(p["lat"])) * F.sin(r) * F.cos(a))
        lng = F.radians(p["lng"]) + F.atan2(F.sin(a) * F.sin(r) * F.cos(F.radians(p["lat"])), F.cos(r) - F.sin(F.radians(p["lat"])) * F.sin(lat))
        return point(F.degrees(lng), F.degrees(lat))

    return geometry("Polygon", F.array(F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: corner(F.when(i == corners, 0).otherwise(i)))))


def ring_area(ring: Column) -> Column:
    """Twice the signed area in square degrees: positive where the ring runs counter-clockwise."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    steps = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda p, q: (q["lng"] - p["lng"]) * (q["lat"] + p["lat"]))
    return -F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def exterior(g: ColumnOrName) -> Column:
    """The polygon, or each of several, without its holes."""
    several = _c(g)["kind"] == "MultiPolygon"
    return geometry(_c(g)["kind"], F.when(several, F.filter(_c(g)["parts"], lambda r: ring_area(r) >= 0)).otherwise(F.slice(_c(g)["parts"], 1, 1)))


def union_agg(g: ColumnOrName) -> Column:
    """An aggregate: shapes as one list, for `any_contains`; overlaps stay as they are."""
    return F.collect_list(_c(g))


def any_contains(shapes: ColumnOrName, lng: ColumnOrName, lat: ColumnOrName) -> Column:
    return F.exists(_c(shapes), lambda s: contains(s, lng, lat))


def bounds_agg(g: ColumnOrName) -> list[Column]:
    """Aggregates west, south, east and north of all shapes of a group."""
    b = bounds(g)
    return [f(b[n]).alias(n) for f, n in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"))]


# --- text and binary forms ---


def _joined(g: Column, parts: Column, opens: str, closes: str) -> Column:
    """Written parts of a geometry, nested as its kind asks for."""
    starts = F.transform(g["parts"], lambda r, i: (i > 0) & (ring_area(r) >= 0))
    glued = F.array_join(F.zip_with(starts, parts, lambda new, part: F.concat(F.when(new, F.lit(f"{closes}, {opens}")).otherwise(F.lit(", ")), part)), "")
    polygons = F.concat(F.lit(opens * 2), F.substr(glued, F.lit(3)), F.lit(closes * 2))
    listed = F.concat(F.lit(opens), F.array_join(parts, ", "), F.lit(closes))
    return F.when(g["kind"] == "MultiPolygon", polygons).when(g["kind"].isin("Polygon", "MultiLineString", "MultiPoint"), listed).otherwise(F.array_join(parts, ", "))


def as_text(g: ColumnOrName) -> Column:
    """WKT of points, lines and polygons, one or several."""
    pair = lambda p: F.concat_ws(" ", p["lng"].cast("string"), p["lat"].cast("string"))
    lists = F.transform(_c(g)["parts"], lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, pair), ", "), F.lit(")")))
    return F.concat(F.upper(_c(g)["kind"]), _joined(_c(g), lists, "(", ")"))


def as_geojson(g: ColumnOrName) -> Column:
    pair = lambda p: F.to_json(F.array(p["lng"], p["lat"]))
    points = lambda part: F.array_join(F.transform(part, pair), ",")
    bare = _c(g)["kind"].isin("Point", "MultiPoint")
    lists = F.transform(_c(g)["parts"], lambda part: F.when(bare, points(part)).otherwise(F.concat(F.lit("["), points(part), F.lit("]"))))
    return F.concat(F.lit('{"type":"'), _c(g)["kind"], F.lit('","coordinates":'), _joined(_c(g), lists, "[", "]"), F.lit("}"))


def _turned(ring: list[tuple[float, float]], outer: bool) -> list[tuple[float, float]]:
    """The ring counter-clockwise if it is an outer one, else clockwise."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
    return ring if (area >= 0) == outer else ring[::-1]


def _parts(kind: str, polygons: list) -> list[list[dict]]:
    """Parts of a geometry from its coordinates: a list of points for each part, of several polygons a list of rings for each."""
    rings = [_turned(r, k == 0) for polygon in polygons for k, r in enumerate(polygon)] if kind == "MultiPolygon" else polygons
    return [[{"lng": x, "lat": y} for x, y in r] for r in rings]


def parse_wkt(text: str | None) -> dict | None:
    """POINT, LINESTRING, POLYGON and their MULTI forms, as kind and parts; None where it is none of them."""
    m = re.match(r"\s*(?:SRID=\d+;)?\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*Z?\s*(\(.*\))\s*$", text or "", re.I | re.S)
    if not m:
        return None
    name = ("Multi" if m[1] else "") + {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}[m[2].upper()]

    def rings(body: str) -> list[list[tuple[float, float]]]:
        found = [[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]*)\)", body)]
        if any(len(p) != 2 for ring in found for p in ring):
            raise ValueError
        return found

    try:
        if name == "MultiPolygon":
            own = [rings(x) for x in re.findall(r"\((\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*)\)", m[3])]
        else:
            own = rings(m[3])
    except ValueError:
        return None
    if name == "MultiPoint":
        own = [[p] for points in own for p in points]
    return {"kind": name, "parts": _parts(name, own)} if own else None


def to_wkb(g: dict | None) -> bytes | None:
    """Little-endian WKB of points, lines and polygons with holes."""
    if g is None:
        return None
    kind = g["kind"]
    code = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}[kind]
    flat = [[(p["lng"], p["lat"]) for p in part] for part in g["parts"]]
    head = binary.pack("<BI", 1, code)
    points = lambda ps: b"".join(binary.pack("<dd", *p) for p in ps)
    ring = lambda ps: binary.pack("<I", len(ps)) + points(ps)
    if kind == "Point":
        return head + points(flat[0][:1])
    if kind == "LineString":
        return head + ring(flat[0])
    if kind == "Polygon":
        return head + binary.pack("<I", len(flat)) + b"".join(map(ring, flat))
    if kind == "MultiPolygon":
        polygons: list[list] = []
        for r in flat:
            if not polygons or _turned(r, True) is r:
                polygons.append([])
            polygons[-1].append(r)
        return head + binary.pack("<I", len(polygons)) + b"".join(binary.pack("<BII", 1, 3, len(p)) + b"".join(map(ring, p)) for p in polygons)
    single = {4: lambda ps: binary.pack("<BI", 1, 1) + points(ps[:1]), 5: lambda ps: binary.pack("<BI", 1, 2) + ring(ps)}[code]
    return head + binary.pack("<I", len(flat)) + b"".join(map(single, flat))


def from_text(wkt: ColumnOrName) -> Column:
    @F.pandas_udf(GEOMETRY.replace(":", " "))
    def parse(s: pd.Series) -> pd.DataFrame:
        found = [parse_wkt(x) or {"kind": None, "parts": None} for x in s]
        return pd.DataFrame(found, columns=["kind", "parts"])

    g = parse(_c(wkt))
    return F.when(g["kind"].isNotNull(), g)


def as_binary(g: ColumnOrName) -> Column:
    @F.pandas_udf("binary")
    def write(s: pd.Series) -> pd.Series:
        return pd.Series([to_wkb(parse_geojson(x)) if x is not None else None for x in s], dtype=object)

    return write(as_geojson(g))


# --- polylines ---


def encode_points(points: list[tuple[float, float]]) -> str:
    """(lat, lng) pairs as text: differences in 1e-5 degrees, zig-zag, five bits a character."""
    out, last = [], (0, 0)
    for p in points:
        now = tuple(math.floor(v * 1e5 + 0.5) for v in p)
        for a, b in zip(now, last, strict=True):
            v = (a - b) << 1 if a >= b else ~((a - b) << 1)
            while v >= 0x20:
                out.append(chr((v & 0x1F | 0x20) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def decode_points(text: str) -> list[tuple[float, float]]:
    values, v, shift = [], 0, 0
    for c in text:
        bits = ord(c) - 63
        v |= (bits & 0x1F) << shift
        shift += 5
        if bits < 0x20:
            values.append(~(v >> 1) if v & 1 else v >> 1)
            v, shift = 0, 0
    lat = np.cumsum(values[::2]) / 1e5
    lng = np.cumsum(values[1::2]) / 1e5
    return list(zip(lat.tolist(), lng.tolist(), strict=True))


def encode_polyline(points: Column) -> Column:
    @F.pandas_udf("string")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda ps: None if ps is None else encode_points([(p["lat"], p["lng"]) for p in ps]))

    return encode(points)


def decode_polyline(text: ColumnOrName) -> Column:
    @F.pandas_udf(f"array<{POINT.replace(':', ' ')}>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"lng": x, "lat": y} for y, x in decode_points(t)])

    return decode(_c(text))


# --- ellipsoid, simplification ---


def ellipsoid_distance(lng1, lat1, lng2, lat2) -> np.ndarray:
    """Metres on WGS84 by the inverse method of iterated longitudes; nearly antipodal points stop after 200 rounds."""
    lng1, lat1, lng2, lat2 = (np.radians(np.asarray(x, float)) for x in (lng1, lat1, lng2, lat2))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(lat1)), np.arctan((1 - WGS84_F) * np.tan(lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    across = lng2 - lng1
    lam = across.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, cu1 * cu2 * sl / np.where(ss > 0, ss, 1), 0)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 > 0, cs - 2 * su1 * su2 / np.where(ca2 > 0, ca2, 1), 0)
            c = WGS84_F / 16 * ca2 * (4 + WGS84_F * (4 - 3 * ca2))
            new = across + (1 - c) * WGS84_F * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(done):
                break
        us = ca2 * (WGS84_A**2 - b * b) / (b * b)
        ka = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
        kb = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
        ds = kb * ss * (cm + kb / 4 * (cs * (2 * cm * cm - 1) - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        return np.where(ss == 0, 0.0, b * ka * (sigma - ds))


def ellipsoid_length(points: Column) -> Column:
    """Metres along points on WGS84; differs from `length`, which is spherical."""

    @F.pandas_udf("double")
    def measure(s: pd.Series) -> pd.Series:
        def one(ps):
            if ps is None:
                return None
            x, y = np.array([p["lng"] for p in ps]), np.array([p["lat"] for p in ps])
            return float(ellipsoid_distance(x[:-1], y[:-1], x[1:], y[1:]).sum()) if len(x) > 1 else 0.0

        return s.map(one).astype("float64")

    return measure(points)


def simplified_points(points: list[tuple[float, float]], metres: float) -> list[tuple[float, float]]:
    """Of a (lng, lat) path, the points that lie off the chords of the others by more than the tolerance."""
    if len(points) < 3:
        return points
    p = np.array(points)
    m = math.pi / 180 * EARTH_M
    xy = np.stack([p[:, 0] * math.cos(math.radians(p[:, 1].mean())), p[:, 1]], axis=1) * m
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, z = todo.pop()
        if z - a < 2:
            continue
        d, own = xy[z] - xy[a], xy[a + 1 : z] - xy[a]
        n = math.hypot(*d)
        off = np.abs(d[0] * own[:, 1] - d[1] * own[:, 0]) / n if n else np.hypot(own[:, 0], own[:, 1])
        k = int(off.argmax())
        if off[k] > metres:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, z)]
    return [points[i] for i in np.flatnonzero(keep)]


def simplify(g: ColumnOrName, metres: float) -> Column:
    """Fewer points, none of the dropped ones further than the tolerance from what stays; rings keep four."""

    @F.pandas_udf(GEOMETRY.replace(":", " "))
    def run(s: pd.Series) -> pd.DataFrame:
        def part(points, closed):
            flat = [(p["lng"], p["lat"]) for p in points]
            new = simplified_points(flat, metres)
            return [{"lng": x, "lat": y} for x, y in (flat if closed and len(new) < 4 else new)]

        shapes = [parse_geojson(x) if x is not None else {"kind": None, "parts": None} for x in s]
        parts = [None if g["parts"] is None else [part(p, g["kind"].endswith("Polygon")) for p in g["parts"]] for g in shapes]
        return pd.DataFrame({"kind": [g["kind"] for g in shapes], "parts": parts})

    new = run(as_geojson(g))
    return F.when(_c(g).isNotNull(), new)


# --- the same measures in SQL, for oracles ---


def haversine_sql(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return f"(2 * {EARTH_M} * asin(sqrt(least(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lng2}) - radians({lng1})) / 2), 2), 1.0))))"


def parse_geojson(text: str) -> dict:
    """kind and parts of a GeoJSON geometry."""
    g = json.loads(text)
    c = g["coordinates"]
    kind = g["type"]
    pairs = lambda points: [(float(p[0]), float(p[1])) for p in points]
    if kind == "MultiPolygon":
        own = [[pairs(ring) for ring in polygon] for polygon in c]
    elif kind in ("Point", "MultiPoint"):
        own = [pairs([p]) for p in ([c] if kind == "Point" else c)]
    else:
        own = [pairs(part) for part in ([c] if kind == "LineString" else c)]
    return {"kind": kind, "parts": _parts(kind, own)}
