"""Counts of places per grid cell with sample ids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, grid
from ..schema import ATTRIBUTES
from .top import counted_with_first


@dataclass(frozen=True)
class DensityRequest:
    """What a density function takes; empty fields do not filter."""

    lng: float
    lat: float
    radius: float
    grid: str = "square"
    cell: float = 0.01
    business_status: Sequence[str] = ()
    types: Sequence[str] = ()
    primary_type: Sequence[str] = ()
    price_level: Sequence[str] = ()
    min_rating: float | None = None
    max_rating: float | None = None
    attributes: Sequence[str] = field(default=())
    samples: int = 20

    def __post_init__(self):
        if unknown := set(self.attributes) - set(ATTRIBUTES):
            raise ValueError(f"no such attributes: {sorted(unknown)}")


def near(df: DataFrame, point: str, lng: float, lat: float, metres: float) -> DataFrame:
    """Rows within a radius of a constant point; a box of plain comparisons comes first."""
    dy = metres / grid.DEGREE_M
    dx = geo.math.degrees(geo.math.asin(min(1.0, geo.math.sin(metres / geo.EARTH_M) / max(1e-9, geo.math.cos(geo.math.radians(lat))))))
    p = F.col(point)
    box = p["lng"].between(lng - dx, lng + dx) & p["lat"].between(lat - dy, lat + dy)
    return df.where(box & geo.dwithin(p, geo.point(F.lit(lng), F.lit(lat)), metres))


def places_count_per_cell(places: DataFrame, request: DensityRequest) -> DataFrame:
    """(cell, count, sample_place_ids): cells with places, however few; the smallest ids are the sample."""
    df = near(places, "point", request.lng, request.lat, request.radius)
    for column, values in (("business_status", request.business_status), ("primary_type", request.primary_type), ("price_level", request.price_level)):
        if values:
            df = df.where(F.col(column).isin(*values))
    if request.types:
        df = df.where(F.arrays_overlap("types", F.array(*map(F.lit, request.types))))
    if request.min_rating is not None:
        df = df.where(F.col("rating") >= request.min_rating)
    if request.max_rating is not None:
        df = df.where(F.col("rating") <= request.max_rating)
    for a in request.attributes:
        df = df.where(F.col(a))
    keyed = df.select(grid.cells(request.grid, request.cell)(F.col("point")).alias("cell"), "id")
    return counted_with_first(keyed, "cell", "id", request.samples, "count", "sample_place_ids")
