"""Spatial joins as equi-joins on grid cells, refined exactly.

The right side is covered with square cells and exploded; the left side has one
cell a point. Spark then joins on the cell as on any key: by broadcast where a
side is small, split where a cell is skewed. No nested loop is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, grid


def _turns(cell: float) -> int:
    n = round(360 / cell)
    if abs(n * cell - 360) > 1e-9:
        raise ValueError("a cell must divide 360 degrees")
    return n


def _cells(west: Column, south: Column, east: Column, north: Column, cell: float) -> Column:
    """Cells of a box; columns wrap at the antimeridian, rows stop at the poles."""
    n = _turns(cell)
    xs = F.sequence(grid.square_index(west, cell), F.least(grid.square_index(east, cell), grid.square_index(west, cell) + n - 1))
    ys = F.sequence(grid.square_index(F.greatest(south, F.lit(-90.0)), cell), grid.square_index(F.least(north, F.lit(90.0)), cell))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(F.pmod(x, F.lit(n)).alias("cx"), y.alias("cy")))))


def _of_point(df: DataFrame, p: str, cell: float) -> DataFrame:
    return df.withColumn("cx", F.pmod(grid.square_index(F.col(p)["lng"], cell), F.lit(_turns(cell)))).withColumn("cy", grid.square_index(F.col(p)["lat"], cell))


def points_in_polygons(points: DataFrame, polygons: DataFrame, point: str, polygon: str, cell: float = 0.05) -> DataFrame:
    """Pairs of a point and a polygon that contains it, with the columns of both.

    A point has one cell and a polygon each cell once, so no pair comes twice.
    """
    b = geo.bounds(polygon)
    covered = polygons.withColumn("_cell", F.explode(_cells(b["west"], b["south"], b["east"], b["north"], cell))).withColumn("cx", F.col("_cell.cx")).withColumn("cy", F.col("_cell.cy")).drop("_cell")
    joined = _of_point(points, point, cell).join(covered, ["cx", "cy"]).drop("cx", "cy")
    return joined.where(geo.contains(polygon, F.col(point)["lng"], F.col(point)["lat"]))


def within_distance(left: DataFrame, right: DataFrame, left_point: str, right_point: str, metres: float, cell: float = 0.02) -> DataFrame:
    """Pairs of points at most so far apart, with the columns of both; put the smaller side left.

    The left point's cells reach as far as the radius does at its latitude,
    where a degree of longitude is shortest within reach.
    """
    dy = metres / grid.DEGREE_M
    p = F.col(left_point)
    dx = dy / F.greatest(F.cos(F.radians(F.least(F.abs(p["lat"]) + dy, F.lit(89.9)))), F.lit(1e-6))
    covered = left.withColumn("_cell", F.explode(_cells(p["lng"] - dx, p["lat"] - dy, p["lng"] + dx, p["lat"] + dy, cell))).withColumn("cx", F.col("_cell.cx")).withColumn("cy", F.col("_cell.cy")).drop("_cell")
    joined = covered.join(_of_point(right, right_point, cell), ["cx", "cy"]).drop("cx", "cy")
    return joined.where(geo.dwithin(F.col(left_point), F.col(right_point), metres))


def left_within_distance(left: DataFrame, right: DataFrame, key: str, left_point: str, right_point: str, metres: float, aggs: list[Column], where: Column | None = None, cell: float = 0.02) -> DataFrame:
    """Per left row aggregates over the right rows near it; left rows without any stay, their aggregates null.

    where: a condition on right rows that belongs to the join, so that left rows
    are kept. Aggregates must not need rows to exist; fill counts afterwards.
    """
    right = right.where(where) if where is not None else right
    near = within_distance(left.select(key, left_point), right, left_point, right_point, metres, cell)
    return left.join(near.groupBy(key).agg(*aggs), key, "left")


def crossing_polygons(shapes: DataFrame, polygons: DataFrame, shape: str, polygon: str, shape_id: str, polygon_id: str, cell: float = 0.05) -> DataFrame:
    """(shape_id, polygon_id): a line or polygon and a polygon it meets; shapes that share several cells are paired once."""
    a, b = geo.bounds(shape), geo.bounds(polygon)
    split = lambda df, x: df.withColumn("_cell", F.explode(_cells(x["west"], x["south"], x["east"], x["north"], cell))).withColumn("cx", F.col("_cell.cx")).withColumn("cy", F.col("_cell.cy")).drop("_cell")
    pairs = split(shapes.select(shape_id, shape), a).join(split(polygons.select(polygon_id, polygon), b), ["cx", "cy"])
    # Both meet first in one cell: that of the larger west and south of their boxes.
    wx = F.pmod(grid.square_index(F.greatest(a["west"], b["west"]), cell), F.lit(_turns(cell)))
    wy = grid.square_index(F.greatest(a["south"], b["south"]), cell)
    return pairs.where((F.col("cx") == wx) & (F.col("cy") == wy)).where(geo.intersects(shape, polygon)).select(shape_id, polygon_id)
