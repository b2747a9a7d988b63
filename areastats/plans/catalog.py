"""Registered queries: one per operator of the inventory.

Every query takes ``(spark, sf_dir)``, reads the driver's tables through the fixture views
and returns a lazy DataFrame over all rows: building one runs no job. (The source and sink
queries of ``catalog_io`` write their file when built, and return the lazy read of it.)
``SQL[name]`` is the same query in DuckDB SQL.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle as O
from .. import schemas as S
from ..functions.measures import skip_null_sum, strict_sum
from ..operators.lookups import NORTH_REGION_CODES
from ..sources.fixtures import Fixtures, fixtures
from .area import LEVELS, AreaQuery, area_table, la_headlines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NORTH_SQL = "(" + ", ".join(f"'{c}'" for c in NORTH_REGION_CODES) + ")"


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return fixtures(spark, sf_dir)


# =========================================================================================
# Area tables (A1-A28) from one parameter table, with SQL generated from the same table
# =========================================================================================
AREA = {
    "national_totals": AreaQuery(level="national"),
    "national_gva_per_job": AreaQuery(level="national", metric="gva_per_job"),
    "region_registered_totals": AreaQuery(level="region"),
    "region_registered_gva_per_job": AreaQuery(level="region", metric="gva_per_job"),
    "la_registered_totals": AreaQuery(level="la"),
    "la_registered_gva_per_job": AreaQuery(level="la", metric="gva_per_job"),
    "north_la_registered_totals": AreaQuery(level="la", scope="north"),
    "north_la_registered_gva_per_job": AreaQuery(level="la", scope="north", metric="gva_per_job"),
    "itl2_registered_totals_raw": AreaQuery(level="itl2", itl="raw"),
    "itl2_registered_totals": AreaQuery(level="itl2"),
    "itl2_registered_gva_per_job_raw": AreaQuery(level="itl2", itl="raw", metric="gva_per_job"),
    "itl2_registered_gva_per_job": AreaQuery(level="itl2", metric="gva_per_job"),
    "north_itl2_registered_totals_raw": AreaQuery(level="itl2", itl="raw", scope="north"),
    "north_itl2_registered_gva_per_job_raw": AreaQuery(level="itl2", itl="raw", scope="north",
                                                       metric="gva_per_job"),
    "la_sites_totals": AreaQuery(basis="sites", level="la"),
    "region_sites_totals": AreaQuery(basis="sites", level="region", distinct_sites=True),
    "la_sites_gva_per_job": AreaQuery(basis="sites", level="la", metric="gva_per_job"),
    "region_sites_gva_per_job": AreaQuery(basis="sites", level="region", metric="gva_per_job"),
    "north_la_sites_totals": AreaQuery(basis="sites", level="la", scope="north"),
    "north_la_sites_gva_per_job": AreaQuery(basis="sites", level="la", scope="north",
                                            metric="gva_per_job", count_name=S.NO_SITES),
    "itl2_sites_totals": AreaQuery(basis="sites", level="itl2"),
    "itl2_sites_gva_per_job": AreaQuery(basis="sites", level="itl2", metric="gva_per_job"),
    "north_itl2_sites_totals": AreaQuery(basis="sites", level="itl2", scope="north"),
    "north_itl2_sites_gva_per_job": AreaQuery(basis="sites", level="itl2", scope="north",
                                              metric="gva_per_job", count_name=S.NO_SITES),
    "national_registered_totals_north": AreaQuery(level="national", scope="north"),
    "national_sites_totals_north": AreaQuery(basis="sites", level="national", scope="north"),
    "la_code_totals_north": AreaQuery(basis="la_codes", level="la_code", metric="headline", scope="north"),
    "region_sites_headlines_north": AreaQuery(basis="sites", level="region21", metric="headline",
                                              count_name=S.NO_SITES, distinct_sites=True, scope="north"),
    "la_code_totals": AreaQuery(basis="la_codes", level="la_code", metric="headline"),
    "region_sites_headlines": AreaQuery(basis="sites", level="region21", metric="headline",
                                        count_name=S.NO_SITES, distinct_sites=True),
}

# per basis: SQL source view, totals columns and whether funding skips NULLs
_SQL_BASIS = {
    "registered": ("reg_located", [S.GVA, S.TURNOVER, S.EMPLOYEES, S.INNOVATE,
                                   "TotalDealroomFunding"], False, S.NO_COMPANIES),
    "sites": ("sites_located", [S.PER_SITE[k] for k in ("gva", "turnover", "employees",
                                                        "innovate", "dealroom")], True,
              S.NO_SITES),
    "la_codes": ("la_rows", [S.PER_LA[k] for k in ("gva", "turnover", "employees",
                                                   "innovate", "dealroom")], True,
                 S.NO_COMPANIES),
}


def area_sql(q: AreaQuery, rollup: bool = False, matched: bool = False) -> str:
    """The area query in SQL, written at row level (join first, aggregate after).
    ``rollup`` adds the total row labelled 'Total' (R1), ``matched`` drops the unmatched area."""
    src, cols, funding_strict, default_count = _SQL_BASIS[q.basis]
    key = LEVELS[q.level]
    ctes = [src]
    frm = f"{src} t"
    if q.distinct_sites:
        frm = f"(SELECT DISTINCT * FROM {src}) t"
    joins = ""
    if q.level == "itl2":
        it = "itl_raw" if q.itl == "raw" else "itl_dedup"
        ctes.append(it)
        joins = f" LEFT JOIN {it} i ON t.ladcd = i.LAD23CD"
    if q.basis == "la_codes" and q.level not in ("la_code", "region21") and (q.level != "national" or q.scope == "north"):
        ctes.append("la_region")
        frm = f"(SELECT x.*, x.LAcode AS ladcd, lr.* EXCLUDE (LAD23CD) FROM la_rows x LEFT JOIN la_region lr ON x.LAcode = lr.LAD23CD) t"
    if q.level == "region21" or (q.level == "la_code" and q.scope == "north"):
        ctes.append("la_region21")
        place = "LAcode" if q.basis == "la_codes" else "ladcd"
        joins = f" JOIN la_region21 r21 ON t.{place} = r21.LAD21CD"
    where = []
    if q.metric == "gva_per_job":
        where.append(f"t.{S.GVA} > 0 AND t.{S.EMPLOYEES} > 0")
    if q.scope == "north":
        where.append((f"r21.{S.RGN21CD}" if q.level in ("region21", "la_code") else f"t.{S.RGN23CD}") + f" IN {NORTH_SQL}")
    if matched:
        where.append(f"t.{key} IS NOT NULL")
    wh = (" WHERE " + " AND ".join(where)) if where else ""
    if q.metric == "gva_per_job":
        count = q.count_name or S.NO_COMPANIES
        vals = [f"count(*) AS {count}",
                O.ratio(O.strict_sum(S.GVA), O.strict_sum(S.EMPLOYEES)) + f" AS {S.GVA_PER_JOB}"]
    else:
        count = q.count_name or default_count
        sums = []
        for i, (name, c) in enumerate(zip(("GVA", "Turnover", "Employees", "InnovateFunding",
                                           "DealroomFunding"), cols)):
            f = O.strict_sum if (i < 3 or funding_strict) else O.skip_sum
            sums.append((name, f(c)))
        d = dict(sums)
        vals = [f"count(*) AS {count}"] + [f"{e} AS {n}" for n, e in sums[:3]]
        if q.metric == "headline":
            vals.append(O.ratio(d["GVA"], d["Employees"]) + f" AS {S.GVA_JOB}")
        vals += [f"{e} AS {n}" for n, e in sums[3:]]
    if key is None:
        return O.with_ctes(ctes, f"SELECT {', '.join(vals)} FROM {frm}{joins}{wh}")
    kexpr = {"LAcode": "t.LAcode", "ITL221NM": "i.ITL221NM", "RGN21NM": "r21.RGN21NM"}.get(
        key, f"t.{key}")
    if rollup:
        return O.with_ctes(ctes, f"SELECT CASE WHEN GROUPING({kexpr}) = 1 THEN 'Total' ELSE {kexpr} END "
                                 f"AS {key}, {', '.join(vals)} FROM {frm}{joins}{wh} GROUP BY ROLLUP ({kexpr})")
    return O.with_ctes(ctes, f"SELECT {kexpr} AS {key}, {', '.join(vals)} FROM {frm}{joins}{wh} "
                             f"GROUP BY {kexpr} ORDER BY {key} NULLS LAST")


def area(fx: Fixtures, q: AreaQuery) -> DataFrame:
    """An area table over the fixture views, the sites in long form."""
    return area_table(fx.company_long(), fx.geography, q, site_pairs=fx.site_pairs())


def _area_query(q: AreaQuery) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return area(_fx(spark, sf_dir), q)
    return run


for _name, _q in AREA.items():
    register(_name, area_sql(_q))(_area_query(_q))


def _with_extra_cte(ctes: list[str], extra: dict[str, str], body: str) -> str:
    """``WITH`` the fixture CTEs, then named extra CTEs (in order), then ``body``."""
    base = O.with_ctes(ctes, "")
    more = ",\n".join(f"{k} AS ({v})" for k, v in extra.items())
    return base.rstrip("\n") + (",\n" + more if more else "") + "\n" + body


def _area_body(name: str | AreaQuery) -> str:
    """The SELECT of an area query without its WITH clause (for use as a CTE)."""
    q = AREA[name] if isinstance(name, str) else name
    return "SELECT " + area_sql(q).split("\nSELECT ", 1)[1]


def _area_ctes(name: str | AreaQuery) -> list[str]:
    q = AREA[name] if isinstance(name, str) else name
    src = _SQL_BASIS[q.basis][0]
    out = [src]
    if q.level == "itl2":
        out.append("itl_raw" if q.itl == "raw" else "itl_dedup")
    if q.level == "region21":
        out.append("la_region21")
    return out


@register("national_la_headlines",
          _with_extra_cte(["la_rows", "la_region21", "lad_boundary21"],
                          {"h": "SELECT " + area_sql(AREA["la_code_totals"]).split("\nSELECT ", 1)[1]},
                          "SELECT DISTINCT b.LAD21NM AS LAD21NM, r.RGN21NM AS RGN21NM, "
                          "h.No_Companies AS No_Companies, h.GVA AS GVA, h.Turnover AS Turnover, "
                          "h.Employees AS Employees, h.GVA_job AS GVA_job, "
                          "h.InnovateFunding AS InnovateFunding, h.DealroomFunding AS DealroomFunding "
                          "FROM h JOIN la_region21 r ON h.LAcode = r.LAD21CD "
                          "JOIN lad_boundary21 b ON h.LAcode = b.LAD21CD"))
def national_la_headlines(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return la_headlines(fx.company_long(), fx.geography)


@register("northern_la_headlines",
          SQL["national_la_headlines"].replace(
              "ON h.LAcode = b.LAD21CD", f"ON h.LAcode = b.LAD21CD WHERE r.RGN21CD IN {NORTH_SQL}"))
def northern_la_headlines(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return la_headlines(fx.company_long(), fx.geography, north=True)


@register("strict_sum", O.with_ctes(["fx_company"], (
    f"SELECT Registeredpostcode AS {S.REG_POSTCODE}, count(*) AS {S.NO_COMPANIES}, "
    f"{O.strict_sum(S.INNOVATE)} AS InnovateFunding_strict, "
    f"{O.skip_sum(S.INNOVATE)} AS InnovateFunding_skip "
    "FROM fx_company GROUP BY Registeredpostcode")))
def strict_sum_query(spark, sf_dir):
    """R's ``sum`` against ``sum(na.rm = TRUE)`` on the nullable Innovate column."""
    c = _fx(spark, sf_dir).company_long()
    return c.groupBy(S.REG_POSTCODE).agg(
        F.count(F.lit(1)).alias(S.NO_COMPANIES),
        strict_sum(F.col(S.INNOVATE)).alias("InnovateFunding_strict"),
        skip_null_sum(F.col(S.INNOVATE)).alias("InnovateFunding_skip"))


@register("skip_null_sum", O.with_ctes(["reg_located"], (
    f"SELECT LAD23NM AS {S.LAD23NM}, {O.skip_sum(S.INNOVATE)} AS InnovateFunding, "
    f"{O.skip_sum('TotalDealroomFunding')} AS DealroomFunding "
    "FROM reg_located GROUP BY LAD23NM")))
def skip_null_sum_query(spark, sf_dir):
    """NULL-skipping funding sums by LA (0 for an LA without any funding)."""
    t = area(_fx(spark, sf_dir), AREA["la_registered_totals"])
    return t.select(S.LAD23NM, S.OUT_INNOVATE, S.OUT_DEALROOM)
