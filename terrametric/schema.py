"""Table models: explicit types for every table of the three domains."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = "struct<lng:double,lat:double>"
#: Points, lines and rings alike are lists of points; a polygon lists its outer ring and then its holes.
#: Of several polygons outer rings run counter-clockwise and holes clockwise, each hole after its polygon's outer ring.
GEOMETRY = f"struct<kind:string,parts:array<array<{POINT}>>>"
LOCATION = "struct<latitude:double,longitude:double>"
PERIODS = "array<struct<start_time:int,end_time:int>>"
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
ATTRIBUTES = ("delivery", "curbside_pickup", "wheelchair_accessible_entrance", "outdoor_seating", "free_parking_lot", "good_for_children", "allows_dogs")
BUSINESS_STATUS = ("OPERATIONAL", "CLOSED_TEMPORARILY", "CLOSED_PERMANENTLY")
PRICE_LEVELS = ("PRICE_LEVEL_FREE", "PRICE_LEVEL_INEXPENSIVE", "PRICE_LEVEL_MODERATE", "PRICE_LEVEL_EXPENSIVE", "PRICE_LEVEL_VERY_EXPENSIVE")
SPEEDS = ("NORMAL", "SLOW", "TRAFFIC_JAM")

RUNNING, INVALID, LOW_USAGE = "STATUS_RUNNING", "STATUS_INVALID", "VALIDATION_ERROR_LOW_ROAD_USAGE"

_HISTORY = f"selected_route_id string, display_name string, record_time timestamp_ntz, duration_in_seconds double, static_duration_in_seconds double, route_geometry {GEOMETRY}"
_STATUS = "selected_route_id string, display_name string, status string, validation_error string, low_road_usage_start_time timestamp_ntz, route_attributes string"
_OBSERVED = f"asset_id string, location {LOCATION}, observation_ids array<string>, gcs_uris array<string>, detection_time timestamp_ntz"

TABLES: dict[str, str] = {
    "historical_travel_time": _HISTORY,
    "recent_roads_data": f"{_HISTORY}, speed_reading_intervals array<struct<interval_coordinates:array<{POINT}>,speed:string>>",
    "routes_status": _STATUS,
    "routes_status_history": f"snapshot_time timestamp, {_STATUS}",
    "division_area": f"id string, names struct<primary:string,common:struct<key_value:array<struct<key:string,value:string>>>>, country string, region string, subtype string, class string, geometry {GEOMETRY}",
    "segment": f"class string, subtype string, geometry {GEOMETRY}",
    "zip_codes": f"zip_code string, city string, state_code string, zip_code_geom {GEOMETRY}",
    "places": f"id string, point {POINT}, types array<string>, primary_type string, business_status string, price_level string, rating double, "
    + ", ".join(f"{a} boolean" for a in ATTRIBUTES)
    + f", regular_opening_hours struct<{','.join(f'{d}:{PERIODS}' for d in DAYS)}>, brand_ids array<string>, "
    + ", ".join(f"administrative_area_level_{k}_id string" for k in range(1, 8))
    + ", administrative_area_level_1_name string, administrative_area_level_2_name string, locality_ids array<string>, "
    + ", ".join(f"sublocality_level_{k}_ids array<string>" for k in range(1, 6))
    + ", neighborhood_ids array<string>, postal_code_ids array<string>, postal_town_ids array<string>, locality_names array<string>, postal_code_names array<string>, country string, is_sample boolean",
    "brands": "id string, name string",
    "all_observations": f"snapshot_id string, asset_id string, asset_type string, location {LOCATION}, detection_time timestamp_ntz, capture_time timestamp_ntz, observation_id string, bbox string, camera_pose struct<latitude:double,longitude:double,altitude:double,heading:double,pitch:double>, gcs_uri string, map_url string",
    "all_assets": f"asset_id string, snapshot_id string, asset_type string, location {LOCATION}",
    "tracks": f"trackId string, observationIds array<string>, geometry {POINT}",
    "observations": "observationId string, captureTimestamp timestamp_ntz, bbox string",
    "urls": "observationId string, signedUrl string",
    "resolution_results": f"{_OBSERVED}, width long, height long",
    "road_sign_results": f"{_OBSERVED}, category string, sign_quality string, description string, image_quality_notes string",
    "pole_results": f"{_OBSERVED}, pole_condition string, type string, material string, transformers long, power_lines long, street_lamps long, junction_boxes long, additional_notes string",
    "jobs": "job_id string, user_email string, creation_time timestamp_ntz, job_type string, statement_type string, query string, total_bytes_billed long, total_bytes_processed long",
    "partitions": "table_name string, partition_id string, total_rows long, total_logical_bytes long, total_billable_bytes long, last_modified_time timestamp, storage_tier string",
}


def schema(table: str) -> T.StructType:
    """The table's type, from its declaration."""
    return T.StructType.fromDDL(TABLES[table])
