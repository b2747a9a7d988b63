"""Measures, exact sums and the reference's two meanings of ``sum``.

Sums of doubles depend on the order rows arrive in, which depends on partitioning. Every
summed measure is therefore rounded once, per summed row, to whole micro-units and summed as
``DECIMAL(38,0)``: order-free, and too wide to overflow below 1e32. A sum of n rows differs
from the real sum by at most n * 5e-7 (so 100 split over three places adds up to 99.999999 or
100.000001). A value that is not a number, infinite or beyond 1e31 raises instead of being
turned into another number.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_POUND = 1e6          # fixed-point resolution of every summed measure
MILLION = 1e6                  # fixed value: Dealroom funding is given in millions
UNITS_TYPE = "decimal(38,0)"
LARGEST = 1e31                 # values from here on can't be summed exactly


def to_units(c: Column) -> Column:
    """Whole micro-units of a double; NULL stays NULL; NaN, infinity and huge values raise."""
    y = c * F.lit(UNITS_PER_POUND)
    r = F.rint(y)                                       # ties go away from zero, not to even
    r = (F.when((y > 0) & (y - r == 0.5), r + 1).when((y < 0) & (r - y == 0.5), r - 1).otherwise(r))
    bad = F.isnan(c) | (F.abs(c) >= F.lit(LARGEST))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a summable value: "), c.cast("string"))).cast(UNITS_TYPE)
                  ).otherwise(r.cast(UNITS_TYPE))


def from_units(c: Column) -> Column:
    """Pounds as a double, rounded once from the exact decimal."""
    return (c / F.lit(Decimal(1000000))).cast("double")


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL instead of an error or infinity when ``den`` is 0."""
    return F.try_divide(num, den)


def round_half_up(c: Column, digits: int) -> Column:
    """Round half up using IEEE steps only (same bits in every engine)."""
    p = float(10 ** digits)
    return F.floor(c * F.lit(p) + F.lit(0.5)) / F.lit(p)


@dataclass(frozen=True)
class Measure:
    """One summed output column.

    ``source`` is the row-level value (a double column name); ``strict`` selects R's
    ``sum(x)`` (one NULL makes the group NULL) over ``sum(x, na.rm = TRUE)`` (NULLs skipped,
    an all-NULL group gives 0).
    """

    name: str
    source: str
    strict: bool = True


def partial_state(measures: list[Measure], prefix: str = "t", where: Column | None = None) -> list[Column]:
    """Aggregate state that can be merged again after a join (decomposable): the row count
    ``{prefix}_n``, and per measure a sum and (strict ones) a count. ``where`` restricts it to
    some rows, so that several states come from one pass."""
    only = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    cols = [F.count(only(F.lit(1))).alias(f"{prefix}_n")]
    for m in measures:
        u = only(to_units(F.col(m.source)))
        cols.append(F.sum(u).alias(f"{prefix}_s_{m.name}"))
        if m.strict:
            cols.append(F.count(u).alias(f"{prefix}_c_{m.name}"))
    return cols


def merge_state(measures: list[Measure], prefix: str = "t") -> list[Column]:
    cols = [F.sum(f"{prefix}_n").alias(f"{prefix}_n")]
    for m in measures:
        cols.append(F.sum(f"{prefix}_s_{m.name}").alias(f"{prefix}_s_{m.name}"))
        if m.strict:
            cols.append(F.sum(f"{prefix}_c_{m.name}").alias(f"{prefix}_c_{m.name}"))
    return cols


def final_value(m: Measure, prefix: str = "t") -> Column:
    s = from_units(F.col(f"{prefix}_s_{m.name}"))
    if m.strict:
        return F.when(F.col(f"{prefix}_c_{m.name}") == F.col(f"{prefix}_n"), s).alias(m.name)
    return F.coalesce(s, F.lit(0.0)).alias(m.name)


def strict_sum(c: Column) -> Column:
    """R's ``sum(x)`` (A29): NULL as soon as one input is NULL. Exact."""
    u = to_units(c)
    return F.when(F.count(u) == F.count(F.lit(1)), from_units(F.sum(u)))


def skip_null_sum(c: Column) -> Column:
    """R's ``sum(x, na.rm = TRUE)`` (A30): NULLs skipped, an all-NULL group gives 0. Exact."""
    return F.coalesce(from_units(F.sum(to_units(c))), F.lit(0.0))
