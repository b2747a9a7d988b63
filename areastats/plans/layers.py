"""Map layers (M1-M17): the table behind each choropleth -- area, measures, geometry.

The drawing itself is not Spark work and is not built. Both sides of these joins are at area
grain (bounded by the boundary file), so Spark's planner broadcasts whichever side its size
estimate allows; nothing grows with the company table here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schemas as S
from ..operators.lookups import Geography
from .area import LEVELS, AreaQuery, area_table, la_headline_frame


def zero_fill(df: DataFrame) -> DataFrame:
    """``replace(is.na(.), 0)`` on the numeric columns (text is left alone, D2)."""
    return df.fillna(0)


def map_layer(summary: DataFrame, boundary: DataFrame, key: str, keep: str = "boundary") -> DataFrame:
    """J10 (``keep='boundary'``): every boundary area, the unmatched (NULL) area dropped.
    J11 (``keep='summary'``): every summary area, with its boundary when there is one.
    Then P14 zero fill. D-4: a summary has one row per area, so repeated map rows can only come
    from repeated boundary rows, which are removed before the join."""
    boundary = boundary.distinct()
    if keep == "boundary":
        joined = boundary.join(summary, on=key, how="left")
    else:
        joined = summary.join(boundary, on=key, how="left")
    return zero_fill(joined)


def boundary_for(geo: Geography, level: str) -> DataFrame:
    if level == "la":
        return geo.lad_boundary
    if level == "itl2":
        return geo.itl2_boundary
    raise ValueError(f"no boundary layer for level {level!r}")


def area_layer(companies: DataFrame, geo: Geography, q: AreaQuery, **given) -> DataFrame:
    """The area table of ``q`` on its boundary layer. National scope keeps every
    boundary (right join in the reference); the northern scope keeps the northern areas."""
    summary = area_table(companies, geo, q, **given)
    key = LEVELS[q.level]
    keep = "boundary" if q.scope == "all" else "summary"
    return map_layer(summary, boundary_for(geo, q.level), key, keep)


def headline_layer(companies: DataFrame, geo: Geography, north: bool = False, **given) -> DataFrame:
    """GVA per job of the LA headline table with its 2021 boundary geometry."""
    g = la_headline_frame(companies, geo, north=north, **given)
    return g.select(S.LAD21NM, S.RGN21NM, S.GVA_JOB, S.GEOMETRY)
