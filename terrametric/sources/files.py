"""File sources and sinks: route CSVs, GeoJSON and its ZIPs, nested asset JSON, JSON lines, snapshots."""

from __future__ import annotations

import io
import json
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..schema import GEOMETRY, POINT

# --- routes from CSV ---


@dataclass(frozen=True)
class RouteColumns:
    """Where a route CSV has its names and coordinates.

    Either `origin` and `destination` hold "(lat, lng)", or the four others are
    separate numbers.
    """

    name: str = "displayName"
    origin: str | None = None
    destination: str | None = None
    origin_lat: str | None = None
    origin_lng: str | None = None
    destination_lat: str | None = None
    destination_lng: str | None = None


def read_route_csv(spark: SparkSession, path: str, columns: RouteColumns) -> tuple[DataFrame, DataFrame]:
    """(good, bad): routes with origin and destination, and the rows that have none.

    A byte order mark is tolerated; a bad row is set aside, not an error.
    """
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})
    if columns.origin:
        ends = [scalar.lat_lng(f"`{c}`") for c in (columns.origin, columns.destination)]
    else:
        of = lambda lng, lat: geo.point(F.col(f"`{lng}`").try_cast("double"), F.col(f"`{lat}`").try_cast("double"))
        ends = [of(columns.origin_lng, columns.origin_lat), of(columns.destination_lng, columns.destination_lat)]
    parsed = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), F.col(f"`{columns.name}`").alias("display_name"), ends[0].alias("origin"), ends[1].alias("destination"))
    sound = lambda c: F.col(f"{c}.lng").isNotNull() & F.col(f"{c}.lat").isNotNull() & F.col(f"{c}.lng").between(-180, 180) & F.col(f"{c}.lat").between(-90, 90)
    ok = F.coalesce(sound("origin") & sound("destination"), F.lit(False))
    return parsed.where(ok).select("display_name", "origin", "destination"), parsed.where(~ok).select("row.*")


def registration_requests(routes: DataFrame, city: str = "area") -> DataFrame:
    """(selected_route_id, body): what a registration service is sent; unnamed rows are named after the city and numbered."""
    named = F.coalesce(F.when(F.length(F.trim("display_name")) > 0, F.col("display_name")), F.concat(F.lit(f"{city}-"), F.monotonically_increasing_id()))
    end = lambda c: F.struct(F.col(f"{c}.lat").alias("latitude"), F.col(f"{c}.lng").alias("longitude"))
    body = F.to_json(F.struct(F.struct(end("origin").alias("origin"), end("destination").alias("destination")).alias("dynamicRoute"), named.alias("displayName")))
    return routes.select(scalar.slug(named).alias("selected_route_id"), body.alias("body"))


# --- GeoJSON ---

def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) per feature of FeatureCollections, plain or the first JSON member of a ZIP.

    A file is one row until its features are exploded, so files should be of a
    size that a task can hold. Features without a geometry have a null one.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    @F.pandas_udf("array<struct<properties map<string, string>, geometry string>>")
    def features(content):
        def one(data: bytes):
            if zipfile.is_zipfile(io.BytesIO(data)):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith((".json", ".geojson"))]
                    data = z.read(names[0]) if names else b"{}"
            found = json.loads(data.decode("utf-8-sig")).get("features", [])
            return [{"properties": {k: v if isinstance(v, str) else json.dumps(v) for k, v in (f.get("properties") or {}).items() if v is not None}, "geometry": json.dumps(f["geometry"]) if f.get("geometry") else None} for f in found]

        return content.map(one)

    rows = files.select(F.explode(features("content")).alias("f"))

    @F.pandas_udf(GEOMETRY.replace(":", " "))
    def parse(s):
        import pandas as pd

        return pd.DataFrame([geo.parse_geojson(x) if x else {"kind": None, "parts": None} for x in s], columns=["kind", "parts"])

    g = parse("f.geometry")
    return rows.select("f.properties", F.when(F.col("f.geometry").isNotNull(), g).alias("geometry"))


def route_records(features: DataFrame) -> DataFrame:
    """Flat registration records of line features: ends, waypoints, box, centre, length and encoded path."""
    points = F.element_at(F.col("geometry.parts"), 1)
    base = features.where(F.col("geometry.kind") == "LineString").select(F.col("properties")["name"].alias("display_name"), F.col("properties")["tag"].alias("tag"), "geometry", points.alias("points"))
    b, centre = geo.bounds("geometry"), geo.mean_vertex("geometry")
    n = F.size("points")
    return base.select(
        "display_name", "tag",
        F.element_at("points", 1).alias("origin"), F.element_at("points", -1).alias("destination"),
        F.when(n > 2, F.slice("points", F.lit(2), n - 2)).otherwise(F.array().cast(f"array<{POINT}>")).alias("waypoints"),
        b.alias("bounds"), centre.alias("center"), (geo.ellipsoid_length(F.col("points")) / 1000).alias("length_km"), geo.encode_polyline(F.col("points")).alias("encoded_polyline"),
    )


def write_zip(records: DataFrame, path: str, member: str = "routes.json", limit: int = 100_000) -> int:
    """A small export: one JSON array in a ZIP file, written by the driver. More rows than the limit is an error."""
    rows = records.toJSON().take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} records; write them as JSON lines instead")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, "[" + ",".join(rows) + "]")
    return len(rows)


# --- JSON ---

_OBSERVATION = "struct<observation_id:string,camera_pose:struct<latitude:double,longitude:double,altitude:double,heading:double,pitch:double>,gcs_uri:string,capture_time:string>"


def read_asset_json(spark: SparkSession, path: str) -> DataFrame:
    """Observations of nested assets; those without a camera's place are dropped."""
    schema = f"asset_id string, asset_type string, location struct<latitude:double,longitude:double>, observations array<{_OBSERVATION}>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    flat = df.select("asset_id", "asset_type", "location", F.explode("observations").alias("o")).select("asset_id", "asset_type", "location", "o.*")
    return flat.where(F.col("camera_pose.latitude").isNotNull() & F.col("camera_pose.longitude").isNotNull())


def read_tuning_lines(spark: SparkSession, path: str) -> DataFrame:
    """(role, text, mime_type, file_uri) per part of tuning examples, with the example's and part's places."""
    schema = "contents array<struct<role:string,parts:array<struct<text:string,fileData:struct<mimeType:string,fileUri:string>>>>>"
    df = spark.read.schema(schema).json(path)
    turns = df.select(F.posexplode("contents").alias("turn", "c"))
    return turns.select("turn", "c.role", F.posexplode("c.parts").alias("part", "p")).select("turn", "part", "role", "p.text", F.col("p.fileData.mimeType").alias("mime_type"), F.col("p.fileData.fileUri").alias("file_uri"))


def annotation_lines(images: DataFrame, uri: str = "gcs_uri", labels: str = "labels") -> DataFrame:
    """`value`: a JSON line per image with its annotations; images without labels are skipped."""
    notes = F.transform(labels, lambda x: F.struct(x.alias("displayName")))
    line = F.to_json(F.struct(F.col(uri).alias("imageGcsUri"), notes.alias("classificationAnnotations")))
    return images.where(F.size(labels) > 0).select(line.alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index; geometries are written as WKT."""
    text = [geo.as_text(c).alias(c) if kind == GEOMETRY else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*text).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv_with_wkt(spark: SparkSession, path: str, schema: str, geometry: str = "location") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows of a CSV file with a header whose geometry column is parsed from WKT, and rows where that fails."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    parsed = df.withColumn("_g", geo.from_text(geometry))
    good = parsed.where("_g is not null").withColumn(geometry, F.col("_g")).drop("_g")
    return good, parsed.where("_g is null").drop("_g")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_paged(spark: SparkSession, fetch, schema: str, key: str = "items", pages: int = 10_000) -> DataFrame:
    """Rows of a paged listing: fetch(token) returns a dict with the rows and maybe nextPageToken.

    Pages depend on each other, so the driver fetches them; the listing must be
    of a size that it can hold.
    """
    rows, token = [], None
    for _ in range(pages):
        page = fetch(token)
        rows += page.get(key, [])
        token = page.get("nextPageToken")
        if not token:
            return spark.createDataFrame(rows, schema)
    raise RuntimeError(f"more than {pages} pages")


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in rows], schema)


def latitude_longitude(location: Column) -> Column:
    """A point from a location with latitude and longitude."""
    return geo.point(location["longitude"], location["latitude"])
