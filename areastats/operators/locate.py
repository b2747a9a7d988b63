"""How a company becomes located rows (the three bases) and the row-level location joins.

basis        rows                         location key      count column
registered   one per company              Registeredpostcode No_Companies
sites        one per company-site (U1)    Postcode          No_sites
la_codes     one per company-LA (U2)      LAcode            No_Companies

Row-level joins (J1-J6, J9) are kept for the operator queries and for inspection. The area
tables in ``plans.area`` do not join at row level: they aggregate by location key first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.measures import MILLION, Measure
from .company import DEALROOM
from .explode import explode_las, explode_sites
from .hot_join import hot_keys, split_join
from .lookups import Geography


def registered_rows(companies: DataFrame) -> DataFrame:
    """One row per company at its registered postcode; Dealroom in pounds."""
    return companies.select(S.COMPANY_ID, S.REG_POSTCODE, S.GVA, S.TURNOVER, S.EMPLOYEES,
                            S.INNOVATE, (F.col(S.DEALROOM_M) * F.lit(MILLION)).alias(DEALROOM))


def site_rows(companies: DataFrame) -> DataFrame:
    return explode_sites(companies)


def la_code_rows(companies: DataFrame) -> DataFrame:
    return explode_las(companies)


def _totals(gva, turnover, employees, innovate, dealroom, funding_strict: bool) -> list[Measure]:
    return [Measure(S.OUT_GVA, gva), Measure(S.OUT_TURNOVER, turnover),
            Measure(S.OUT_EMPLOYEES, employees),
            Measure(S.OUT_INNOVATE, innovate, strict=funding_strict),
            Measure(S.OUT_DEALROOM, dealroom, strict=funding_strict)]


@dataclass(frozen=True)
class Basis:
    name: str
    rows: Callable[[DataFrame], DataFrame]
    location: str                 # column joined to the postcode directory (or an LA code)
    count_name: str               # name of n() in the totals table
    totals: list[Measure] = field(default_factory=list)
    located_by_la: bool = False   # location is already an LA code


REGISTERED = Basis(
    "registered", registered_rows, S.REG_POSTCODE, S.NO_COMPANIES,
    # GVA, turnover and jobs propagate NULL; funding skips it (0 for an empty group)
    _totals(S.GVA, S.TURNOVER, S.EMPLOYEES, S.INNOVATE, DEALROOM, funding_strict=False))

SITES = Basis(
    "sites", site_rows, S.POSTCODE, S.NO_SITES,
    _totals(*[S.PER_SITE[k] for k in ("gva", "turnover", "employees", "innovate", "dealroom")],
            funding_strict=True))

LA_CODES = Basis(
    "la_codes", la_code_rows, S.LACODE, S.NO_COMPANIES,
    _totals(*[S.PER_LA[k] for k in ("gva", "turnover", "employees", "innovate", "dealroom")],
            funding_strict=True),
    located_by_la=True)

BASES = {b.name: b for b in (REGISTERED, SITES, LA_CODES)}


# ---- row-level location joins ------------------------------------------------------------
def join_postcode(rows: DataFrame, geo: Geography, location: str) -> DataFrame:
    """Left join to the postcode directory; adds ``ladcd``."""
    pc = geo.postcode_to_la()
    return rows.join(pc, rows[location] == pc[S.PCDS], "left").drop(pc[S.PCDS])


def join_la_region(rows: DataFrame, geo: Geography) -> DataFrame:
    """Left join LA -> region (2023) on ``ladcd``."""
    lr = geo.la_regions()
    return rows.join(lr, rows[S.LADCD] == lr[S.LAD23CD], "left").drop(lr[S.LAD23CD])


def join_itl(rows: DataFrame, geo: Geography, raw: bool = False) -> DataFrame:
    """J3 (``raw=True``, rows multiply) / J4 (de-duplicated lookup)."""
    it = geo.la_itl2(raw=raw)
    return rows.join(it, rows[S.LADCD] == it[S.LAD23CD], "left").drop(it[S.LAD23CD])


def join_coordinates(rows: DataFrame, geo: Geography, location: str = S.POSTCODE) -> DataFrame:
    """Left join to the coordinate file: a postcode with several rows there gives several
    rows, as in the reference (``Geography.check_keys`` and J12 report such keys). Postcodes
    with very many rows are dealt to several tasks, with all their lookup rows (``hot_join``)."""
    counts = rows.groupBy(location).agg(F.count(F.lit(1)).alias("_rows"))
    lookup = geo.coordinates.withColumnRenamed(S.PCDS, location)
    return split_join(rows, lookup, location, hot_keys(counts, location, "_rows"), "left")


def join_sites_boundary(rows: DataFrame, geo: Geography) -> DataFrame:
    """Left join to the LA boundaries on ``ladcd`` (boundary name kept apart, T13).

    The geometry is attached last, to rows that are in place: rows meet names first, and what is
    shuffled with a row is never a geometry. LAs with very many rows are dealt to several tasks.
    """
    counts = rows.groupBy(S.LADCD).agg(F.count(F.lit(1)).alias("_rows"))
    b = geo.lad_boundary.select(F.col(S.LAD23CD).alias(S.LADCD),
                                F.col(S.LAD23NM).alias("boundary_" + S.LAD23NM), S.GEOMETRY)
    return split_join(rows, b, S.LADCD, hot_keys(counts, S.LADCD, "_rows"), "left")


def locate_rows(companies: DataFrame, geo: Geography, basis: Basis,
                itl: str | None = None) -> DataFrame:
    """Row-level located frame of a basis: postcode -> LA -> region (-> ITL2)."""
    rows = basis.rows(companies)
    if basis.located_by_la:
        rows = rows.withColumn(S.LADCD, F.col(basis.location))
    else:
        rows = join_postcode(rows, geo, basis.location)
    rows = join_la_region(rows, geo)
    if itl is not None:
        rows = join_itl(rows, geo, raw=(itl == "raw"))
    return rows
