"""Scalar expressions with the semantics the queries pin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Null where the divisor is zero or null."""
    return F.try_divide(_c(a), _c(b))


def json_value(json: ColumnOrName, key: str, kind: str = "string") -> Column:
    """A top-level scalar of a JSON text; null where it is missing, an object or an array."""
    v = F.get_json_object(_c(json), f"$.{key}")
    scalar = F.when(~v.rlike(r"^\s*[\[{]"), v)
    return scalar if kind == "string" else scalar.try_cast(kind)


def slug(s: ColumnOrName) -> Column:
    """Lower case, white space to hyphens, nothing but a-z, 0-9 and hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(s)), r"\s", "-"), "[^a-z0-9-]", "")


def first_number(s: ColumnOrName) -> Column:
    found = F.regexp_extract(_c(s), r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found).cast("double")


def last_number(s: ColumnOrName) -> Column:
    return F.try_element_at(F.regexp_extract_all(_c(s), F.lit(r"(-?\d+(?:\.\d+)?)"), 1), F.lit(-1)).cast("double")


def lat_lng(s: ColumnOrName) -> Column:
    """A struct from "(lat, lng)"; null where it doesn't look like that."""
    pattern = r"^\s*\(\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\)\s*$"
    part = lambda k: F.regexp_extract(_c(s), pattern, k).cast("double")
    return F.when(_c(s).rlike(pattern), F.struct(part(2).alias("lng"), part(1).alias("lat")))


def fenced_json(s: ColumnOrName) -> Column:
    """JSON text in a model's reply: a fenced block, else what the outermost braces span, else null."""
    fenced = F.regexp_extract(_c(s), r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(_c(s), r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braces != "", braces)


def category(reply: ColumnOrName) -> Column:
    """Yes, Maybe, No or Error, from how a free-text reply begins."""
    s = F.lower(F.ltrim(_c(reply)))
    return F.when(s.startswith("yes"), "Yes").when(s.startswith("maybe"), "Maybe").when(s.startswith("no"), "No").otherwise("Error")


def clamp(x: ColumnOrName, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def score_band(x: ColumnOrName, high: float = 8, middle: float = 5) -> Column:
    return F.when(_c(x) >= high, "high").when(_c(x) >= middle, "middle").otherwise("low")
