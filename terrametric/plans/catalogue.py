"""All named queries of the library, with their SQL where SQL can express them."""

from __future__ import annotations

from . import assets, engineering, operators, places, roads, science

MODULES = (roads, science, engineering, places, assets, operators)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
