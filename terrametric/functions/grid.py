"""Discrete grids: square cells natively, S2 cells by arithmetic, H3 cells by an installed package."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo
from .scalar import ColumnOrName, _c

#: Metres a degree of latitude.
DEGREE_M = math.pi / 180 * geo.EARTH_M

# --- square cells ---


def square_index(x: ColumnOrName, cell: float) -> Column:
    return F.floor(_c(x) / cell)


def square_id(p: Column, cell: float) -> Column:
    return F.concat_ws(":", square_index(p["lng"], cell).cast("string"), square_index(p["lat"], cell).cast("string"))


def square_boundary(cell_id: ColumnOrName, cell: float) -> Column:
    x, y = (F.split(_c(cell_id), ":")[k].cast("long") for k in (0, 1))
    return geo.rectangle(x * cell, y * cell, (x + 1) * cell, (y + 1) * cell)


# --- S2 cells ---

MAX_LEVEL = 30


def _hilbert() -> tuple[np.ndarray, np.ndarray]:
    """Per orientation and quadrant (i, j) the place along the curve, and the next orientation.

    Orientation 1 swaps the axes, 2 turns both round. The curve visits, unturned,
    (0,0), (0,1), (1,1), (1,0); the first quadrant swaps, the last swaps and turns.
    """
    visits = [(0, 0), (0, 1), (1, 1), (1, 0)]
    place, after = np.zeros((4, 4), np.int64), np.zeros((4, 4), np.int64)
    for o in range(4):
        for k, (i, j) in enumerate(visits):
            if o & 1:
                i, j = j, i
            if o & 2:
                i, j = 1 - i, 1 - j
            place[o, 2 * i + j] = k
            after[o, 2 * i + j] = o ^ (1, 0, 0, 3)[k]
    return place, after


_PLACE, _AFTER = _hilbert()


def _face_st(lng: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.radians(lng), np.radians(lat)
    p = np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])
    axis = np.abs(p).argmax(axis=0)
    main = np.take_along_axis(p, axis[None], axis=0)[0]
    face = np.where(main < 0, axis + 3, axis)
    x, y, z = p
    u = np.choose(face, [y / main, -x / main, -x / main, z / main, z / main, -y / main])
    v = np.choose(face, [z / main, z / main, -y / main, y / main, -x / main, -x / main])
    to_st = lambda w: np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(w)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(w)))
    return face, to_st(u), to_st(v)


def s2_ids(lng, lat, level: int) -> np.ndarray:
    """Signed 64-bit cell ids of points at a level."""
    lng, lat = np.asarray(lng, float), np.asarray(lat, float)
    face, s, t = _face_st(lng, lat)
    size = 1 << MAX_LEVEL
    i, j = (np.clip(np.floor(x * size), 0, size - 1).astype(np.int64) for x in (s, t))
    orientation, path = face & 1, face.astype(np.uint64)
    for bit in range(MAX_LEVEL - 1, MAX_LEVEL - 1 - level, -1):
        q = 2 * (i >> bit & 1) + (j >> bit & 1)
        path = path << np.uint64(2) | _PLACE[orientation, q].astype(np.uint64)
        orientation = _AFTER[orientation, q]
    rest = np.uint64(2 * (MAX_LEVEL - level))
    return ((path << np.uint64(1) | np.uint64(1)) << rest).view(np.int64)


def s2_corners(cell: int) -> list[tuple[float, float]]:
    """(lng, lat) of a cell's corners, counter-clockwise."""
    u = cell & (2**64 - 1)
    low = u & -u
    level = MAX_LEVEL - (low.bit_length() - 1) // 2
    face, orientation, i, j = u >> 61, (u >> 61) & 1, 0, 0
    for k in range(level):
        here = u >> (59 - 2 * k) & 3
        q = int(np.flatnonzero(_PLACE[orientation] == here)[0])
        i, j, orientation = i << 1 | q >> 1, j << 1 | q & 1, int(_AFTER[orientation, q])
    step = 1 / (1 << level)

    def at(s: float, t: float) -> tuple[float, float]:
        a, b = ((4 * w * w - 1) / 3 if w >= 0.5 else (1 - 4 * (1 - w) ** 2) / 3 for w in (s, t))
        x, y, z = [(1, a, b), (-a, 1, b), (-a, -b, 1), (-1, -b, -a), (b, -1, -a), (b, a, -1)][face]
        return math.degrees(math.atan2(y, x)), math.degrees(math.atan2(z, math.hypot(x, y)))

    return [at((i + di) * step, (j + dj) * step) for di, dj in ((0, 0), (1, 0), (1, 1), (0, 1))]


def s2_id(p: Column, level: int) -> Column:
    @F.pandas_udf("long")
    def run(lng: pd.Series, lat: pd.Series) -> pd.Series:
        out = pd.Series(s2_ids(lng.fillna(0), lat.fillna(0), level), index=lng.index).astype("Int64")
        return out.where(lng.notna() & lat.notna())

    return run(p["lng"], p["lat"])


def s2_boundary(cell: ColumnOrName) -> Column:
    @F.pandas_udf("array<array<struct<lng double, lat double>>>")
    def run(s: pd.Series) -> pd.Series:
        def ring(c):
            corners = s2_corners(int(c))
            return [[{"lng": x, "lat": y} for x, y in [*corners, corners[0]]]]

        return s.map(lambda c: None if pd.isna(c) else ring(c))

    return F.when(_c(cell).isNotNull(), geo.geometry("Polygon", run(_c(cell))))


# --- H3 cells ---


def h3_id(p: Column, resolution: int) -> Column:
    """Needs the public package `h3`, whose tables of base cells cannot be derived."""
    if not 0 <= resolution <= 15:
        raise ValueError(f"a resolution is 0 to 15, not {resolution}")
    try:
        import h3
    except ImportError as e:
        raise RuntimeError("H3 cells need the package h3; square and S2 cells don't") from e

    @F.pandas_udf("string")
    def run(lng: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series([h3.latlng_to_cell(y, x, resolution) if pd.notna(x) and pd.notna(y) else None for x, y in zip(lng, lat, strict=True)], dtype=object)

    return run(p["lng"], p["lat"])


def cells(grid: str, size: float) -> Callable[[Column], Column]:
    """A cell id of a point: "square" by degrees, "s2" by level, "h3" by resolution."""
    return {"square": lambda p: square_id(p, size), "s2": lambda p: s2_id(p, int(size)), "h3": lambda p: h3_id(p, int(size))}[grid]
