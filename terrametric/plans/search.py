"""The dynamic search: an area, optional filters and one of three shapes of result.

A request is checked and becomes column conditions; no user text enters SQL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, grid
from ..operators.threshold import MINIMUM, thresholded_agg
from ..schema import ATTRIBUTES, BUSINESS_STATUS, DAYS, PRICE_LEVELS
from ..sources.catalog import places_of


@dataclass(frozen=True)
class Circle:
    lng: float
    lat: float
    metres: float

    def condition(self) -> Column:
        return geo.dwithin(F.col("point"), geo.point(F.lit(self.lng), F.lit(self.lat)), self.metres)


@dataclass(frozen=True)
class Polygon:
    ring: Sequence[tuple[float, float]]

    def condition(self) -> Column:
        xs, ys = zip(*self.ring, strict=True)
        shape = geo.geometry("Polygon", F.array(F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in self.ring])))
        box = F.col("point.lng").between(min(xs), max(xs)) & F.col("point.lat").between(min(ys), max(ys))
        return box & geo.contains(shape, F.col("point.lng"), F.col("point.lat"))


@dataclass(frozen=True)
class Region:
    """Places whose region column, a name or an array of names, has one of the values."""

    column: str
    values: Sequence[str]
    array: bool = True

    def condition(self) -> Column:
        return F.arrays_overlap(self.column, F.array(*map(F.lit, self.values))) if self.array else F.col(self.column).isin(*self.values)


@dataclass(frozen=True)
class Route:
    path: Sequence[tuple[float, float]]
    metres: float

    def condition(self) -> Column:
        line = geo.make_line(F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in self.path]))
        return geo.distance_to_line(F.col("point"), line) <= self.metres


def seconds(time: str) -> int:
    m = re.fullmatch(r"(\d\d):(\d\d)(?::(\d\d))?", time)
    if not m or int(m[1]) > 24 or int(m[2]) > 59:
        raise ValueError(f"no time of day: {time!r}")
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)


@dataclass(frozen=True)
class SearchRequest:
    """hours: "exists" counts a place once, "unnest" once for each period that matches."""

    country: str
    area: Circle | Polygon | Region | Route
    sample: bool = False
    types: Sequence[str] = ()
    primary_type: bool = False
    attributes: Sequence[str] = ()
    min_rating: float | None = None
    max_rating: float | None = None
    business_status: str | None = None
    price_level: str | None = None
    brands: Sequence[str] = ()
    day: str | None = None
    open_after: str | None = None
    open_before: str | None = None
    hours: str = "exists"
    density_cell: float | None = None
    packed: bool = False
    threshold: int = MINIMUM

    def __post_init__(self):
        known = ((self.attributes, ATTRIBUTES), ((self.business_status,) if self.business_status else (), BUSINESS_STATUS), ((self.price_level,) if self.price_level else (), PRICE_LEVELS), ((self.day,) if self.day else (), DAYS))
        for values, allowed in known:
            if unknown := set(values) - set(allowed):
                raise ValueError(f"unknown: {sorted(unknown)}")
        if self.hours not in ("exists", "unnest"):
            raise ValueError(f"hours is exists or unnest, not {self.hours}")

    def open(self, period: Column) -> Column:
        """Open from `open_after` or before it, until `open_before` or after it; no period runs past midnight."""
        parts = [period["start_time"] <= seconds(self.open_after)] if self.open_after else []
        parts += [period["end_time"] >= seconds(self.open_before)] if self.open_before else []
        return reduce(and_, parts)

    @property
    def has_hours(self) -> bool:
        return bool(self.day and (self.open_after or self.open_before))

    def conditions(self) -> list[Column]:
        out = []
        if self.types:
            out.append(F.col("primary_type").isin(*self.types) if self.primary_type else F.arrays_overlap("types", F.array(*map(F.lit, self.types))))
        out += [F.col(a) for a in self.attributes]
        if self.min_rating is not None:
            out.append(F.col("rating") >= self.min_rating)
        if self.max_rating is not None:
            out.append(F.col("rating") <= self.max_rating)
        out += [F.col(c) == v for c, v in (("business_status", self.business_status), ("price_level", self.price_level)) if v]
        if self.has_hours and self.hours == "exists":
            out.append(F.exists(f"regular_opening_hours.{self.day}", self.open))
        return [*out, self.area.condition()]


def search(places: DataFrame, request: SearchRequest, brands: DataFrame | None = None) -> DataFrame:
    """Counts by brand, by type, or per cell; groups below the threshold are withheld."""
    df = places_of(places, request.country, request.sample)
    for c in request.conditions():
        df = df.where(c)
    if request.has_hours and request.hours == "unnest":
        df = df.withColumn("_period", F.explode(f"regular_opening_hours.{request.day}")).where(request.open(F.col("_period")))
    if request.brands:
        if brands is None:
            raise ValueError("a search for brands needs their table")
        chosen = brands.where(F.col("name").isin(*request.brands)).select(F.col("id").alias("_brand"), "name")
        df = df.withColumn("_brand", F.explode("brand_ids")).join(chosen, "_brand")
    k = request.threshold
    if request.density_cell:
        found = thresholded_agg(df.withColumn("cell", grid.square_id(F.col("point"), request.density_cell)), ["cell"], [F.count("*").alias("place_count")], k)
        if not request.packed:
            return found.orderBy(F.desc("place_count"), "cell")
        pairs = F.array_sort(F.collect_list(F.struct("cell", "place_count")))
        return found.agg(pairs.alias("p")).select(F.col("p.cell").alias("indices"), F.col("p.place_count").alias("counts"))
    if request.brands:
        return thresholded_agg(df, ["name"], [F.count("id").alias("count")], k).orderBy(F.desc("count"), "name")
    by_type = [F.count_if(F.array_contains("types", t)).alias(f"{t.replace(' ', '_')}_count") for t in request.types] if len(request.types) > 1 else []
    return thresholded_agg(df, [], [*by_type, F.count("*").alias("total_count")], k)
