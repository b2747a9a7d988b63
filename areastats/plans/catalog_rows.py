"""Registered row-level operator queries: P1-P14, F1-F5, U1-U4, J1-J12, D-1-D-4.

Each is a thin selection of the library code over all rows of the fixture tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from .. import schemas as S
from ..functions.lists import count_items
from ..operators import company as C
from ..operators import explode as X
from ..operators import locate as L
from ..operators.lookups import NORTH_REGION_CODES, north_codes_generated, uniqueness_report
from ..operators.site_pairs import WEIGHT, join_companies, site_pair_rows
from . import layers as M
from .area import la_headlines
from .catalog import AREA, NORTH_SQL, SQL, _area_body, _area_ctes, _fx, _with_extra_cte, area, register

CO = "fx_company"
CC = "company_counts"
PER_SITE = [S.PER_SITE[k] for k in ("turnover", "gva", "employees", "innovate", "dealroom")]
PER_LA = [S.PER_LA[k] for k in ("turnover", "gva", "employees", "innovate", "dealroom")]


def _cols(*names: str) -> str:
    return ", ".join(f"{n} AS {n}" for n in names)


# ---- P: projections and derived columns ------------------------------------------------
@register("project_company_columns", O.with_ctes([CO], f"SELECT {_cols(*C.SITE_COLUMNS)} FROM {CO}"))
def project_company_columns(spark, sf_dir):
    """The columns the site and LA scripts keep."""
    return C.project_company_columns(_fx(spark, sf_dir).company())


@register("project_registered_columns", O.with_ctes([CO], f"SELECT {_cols(*C.REGISTERED_COLUMNS)} FROM {CO}"))
def project_registered_columns(spark, sf_dir):
    """The columns the registered-address scripts keep."""
    return C.project_company_columns(_fx(spark, sf_dir).company_long(), C.REGISTERED_COLUMNS)


@register("count_sites", O.with_ctes([CC], f"SELECT {_cols(S.COMPANY_ID, S.NO_SITES)} FROM {CC}"))
def count_sites(spark, sf_dir):
    c = _fx(spark, sf_dir).company()
    return c.select(S.COMPANY_ID, count_items(S.POSTCODES).alias(S.NO_SITES))


@register("count_las_by_length", O.with_ctes([CC], f"SELECT {_cols(S.COMPANY_ID, S.NO_LAS)} FROM {CC}"))
def count_las_by_length(spark, sf_dir):
    return C.with_list_counts(_fx(spark, sf_dir).company()).select(S.COMPANY_ID, S.NO_LAS)


@register("count_las_exact", O.with_ctes([CO], (
    f"SELECT {S.COMPANY_ID} AS {S.COMPANY_ID}, CAST(length({S.LA_CODES}) - "
    f"length(replace({S.LA_CODES}, ',', '')) + 1 AS BIGINT) AS {S.NO_LAS} FROM {CO}")))
def count_las_exact(spark, sf_dir):
    """The LA count the length rule means (elements of the list)."""
    c = _fx(spark, sf_dir).company()
    return c.select(S.COMPANY_ID, count_items(S.LA_CODES).alias(S.NO_LAS))


_DIFF_SQL = (f"CASE WHEN {S.NO_SITES} - {S.NO_LAS} <> 0 THEN {S.NO_SITES} - {S.NO_LAS} "
             f"WHEN {S.NO_SITES} - {S.NO_LAS} = 0 THEN 0 END")


@register("site_la_difference", O.with_ctes([CC], (
    f"SELECT {_cols(S.COMPANY_ID, S.NO_SITES, S.NO_LAS)}, {_DIFF_SQL} AS {S.DIFFERENCE} FROM {CC}")))
def site_la_difference(spark, sf_dir):
    c = C.with_list_counts(_fx(spark, sf_dir).company())
    return c.select(S.COMPANY_ID, S.NO_SITES, S.NO_LAS, S.DIFFERENCE)


@register("site_la_difference_report", SQL["site_la_difference"] + f" ORDER BY {S.DIFFERENCE} DESC NULLS LAST")
def site_la_difference_report(spark, sf_dir):
    """The (commented-out) check of the reference: largest differences first."""
    return site_la_difference(spark, sf_dir).orderBy(F.desc_nulls_last(S.DIFFERENCE))


@register("apportion_per_site", O.with_ctes([CC], (
    f"SELECT {_cols(S.COMPANY_ID, S.NO_SITES)}, "
    f"{S.TURNOVER} / {S.NO_SITES} AS turn_per_site, {S.GVA} / {S.NO_SITES} AS GVA_per_site, "
    f"{S.EMPLOYEES} / {S.NO_SITES} AS empl_per_site, innovate0 / {S.NO_SITES} AS Innovate_per_site, "
    f"TotalDealroomFunding / {S.NO_SITES} AS Dealroom_per_site FROM {CC}")))
def apportion_per_site(spark, sf_dir):
    c = C.apportion_per_site(_fx(spark, sf_dir).company())
    return c.select(S.COMPANY_ID, S.NO_SITES, *PER_SITE)


@register("apportion_per_la", O.with_ctes([CC], (
    f"SELECT {_cols(S.COMPANY_ID, S.NO_LAS)}, "
    f"{S.TURNOVER} / nullif({S.NO_LAS}, 0) AS turn_per_LA, {S.GVA} / nullif({S.NO_LAS}, 0) AS GVA_per_LA, "
    f"{S.EMPLOYEES} / nullif({S.NO_LAS}, 0) AS empl_per_LA, innovate0 / nullif({S.NO_LAS}, 0) AS Innovate_per_LA, "
    f"TotalDealroomFunding / nullif({S.NO_LAS}, 0) AS Dealroom_per_LA FROM {CC}")))
def apportion_per_la(spark, sf_dir):
    c = C.apportion_per_la(_fx(spark, sf_dir).company())
    return c.select(S.COMPANY_ID, S.NO_LAS, *PER_LA)


@register("gva_per_job_row", O.with_ctes([CO], (
    f"SELECT {S.COMPANY_ID} AS {S.COMPANY_ID}, {O.ratio(S.GVA, S.EMPLOYEES)} AS {S.GVA_PER_JOB_ROW} FROM {CO}")))
def gva_per_job_row(spark, sf_dir):
    return C.gva_per_job_row(_fx(spark, sf_dir).company()).select(S.COMPANY_ID, S.GVA_PER_JOB_ROW)


@register("null_to_zero_measures", O.with_ctes([CO], (
    f"SELECT {S.COMPANY_ID} AS {S.COMPANY_ID}, coalesce({S.INNOVATE}, 0.0) AS {S.INNOVATE}, "
    f"coalesce({S.DEALROOM_M}, 0.0) AS {S.DEALROOM_M} FROM {CO}")))
def null_to_zero_measures(spark, sf_dir):
    c = C.null_to_zero_measures(_fx(spark, sf_dir).company())
    return c.select(S.COMPANY_ID, S.INNOVATE, S.DEALROOM_M)


@register("scale_millions", O.with_ctes([CO], (
    f"SELECT {S.COMPANY_ID} AS {S.COMPANY_ID}, {S.DEALROOM_M} * 1e6 AS TotalDealroomFunding FROM {CO}")))
def scale_millions(spark, sf_dir):
    c = _fx(spark, sf_dir).company()
    return c.select(S.COMPANY_ID, C.scale_millions(S.DEALROOM_M).alias("TotalDealroomFunding"))


@register("area_ratio_column", _with_extra_cte(
    _area_ctes("la_code_totals"), {"h": _area_body("la_code_totals")},
    f"SELECT {_cols(S.LACODE, S.OUT_GVA, S.OUT_EMPLOYEES, S.GVA_JOB)} FROM h"))
def area_ratio_column(spark, sf_dir):
    """GVA per job from the sums of the same summary (the LA-code table)."""
    fx = _fx(spark, sf_dir)
    t = area(fx, AREA["la_code_totals"])
    return t.select(S.LACODE, S.OUT_GVA, S.OUT_EMPLOYEES, S.GVA_JOB)


@register("output_column_order", SQL["national_la_headlines"])
def output_column_order(spark, sf_dir):
    """The headline table in its published column order."""
    fx = _fx(spark, sf_dir)
    return la_headlines(fx.company_long(), fx.geography).select(*S.HEADLINE_COLUMNS)


@register("zero_fill_frame", _with_extra_cte(
    _area_ctes("la_registered_totals") + ["fx_lad_boundary"], {"s": _area_body("la_registered_totals")},
    "SELECT b.LAD23NM AS LAD23NM, b.LAD23CD AS LAD23CD, b.geometry AS geometry, "
    "coalesce(s.No_Companies, 0) AS No_Companies, coalesce(s.GVA, 0.0) AS GVA, "
    "coalesce(s.Turnover, 0.0) AS Turnover, coalesce(s.Employees, 0.0) AS Employees, "
    "coalesce(s.InnovateFunding, 0.0) AS InnovateFunding, coalesce(s.DealroomFunding, 0.0) AS DealroomFunding "
    "FROM fx_lad_boundary b LEFT JOIN s ON b.LAD23NM = s.LAD23NM"))
def zero_fill_frame(spark, sf_dir):
    """The map frame with missing measures as 0 (numbers only, D2)."""
    fx = _fx(spark, sf_dir)
    s = area(fx, AREA["la_registered_totals"])
    return M.zero_fill(fx.geography.lad_boundary.join(s, on=S.LAD23NM, how="left"))


# ---- F: filters ----------------------------------------------------------------------------
@register("filter_positive", O.with_ctes([CO], (
    f"SELECT {_cols(S.COMPANY_ID, S.GVA, S.EMPLOYEES)} FROM {CO} WHERE {S.GVA} > 0 AND {S.EMPLOYEES} > 0")))
def filter_positive(spark, sf_dir):
    c = _fx(spark, sf_dir).company()
    return C.filter_positive(c).select(S.COMPANY_ID, S.GVA, S.EMPLOYEES)


@register("filter_north", O.with_ctes(["reg_located"], (
    f"SELECT {_cols(S.COMPANY_ID, S.LAD23NM, S.RGN23CD)} FROM reg_located WHERE {S.RGN23CD} IN {NORTH_SQL}")))
def filter_north(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = L.locate_rows(fx.company_long(), fx.geography, L.REGISTERED)
    return rows.filter(F.col(S.RGN23CD).isin(*NORTH_REGION_CODES)).select(S.COMPANY_ID, S.LAD23NM, S.RGN23CD)


@register("filter_north_prefix", O.with_ctes(["la_rows", "la_region21"], (
    f"SELECT t.{S.COMPANY_ID} AS {S.COMPANY_ID}, t.{S.LACODE} AS {S.LACODE}, r.RGN21CD AS RGN21CD, "
    f"r.RGN21NM AS RGN21NM FROM la_rows t JOIN la_region21 r ON t.LAcode = r.LAD21CD "
    f"WHERE r.RGN21CD IN {NORTH_SQL}")))
def filter_north_prefix(spark, sf_dir):
    """the northern filter with the generated code list, on company-LA rows."""
    fx = _fx(spark, sf_dir)
    rows = X.explode_las(fx.company()).select(S.COMPANY_ID, S.LACODE)
    lr = fx.geography.la_regions21()
    j = rows.join(lr, rows[S.LACODE] == lr[S.LAD21CD], "inner").drop(lr[S.LAD21CD])
    return j.filter(F.col(S.RGN21CD).isin(*north_codes_generated()))


@register("filter_positive_north", O.with_ctes(["reg_located"], (
    f"SELECT {_cols(S.COMPANY_ID, S.LAD23NM, S.GVA, S.EMPLOYEES)} FROM reg_located "
    f"WHERE {S.GVA} > 0 AND {S.EMPLOYEES} > 0 AND {S.RGN23CD} IN {NORTH_SQL}")))
def filter_positive_north(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = L.locate_rows(fx.company_long(), fx.geography, L.REGISTERED)
    return (rows.filter(C.positive() & F.col(S.RGN23CD).isin(*NORTH_REGION_CODES))
            .select(S.COMPANY_ID, S.LAD23NM, S.GVA, S.EMPLOYEES))


@register("drop_unlisted", O.with_ctes([CO], (
    f"SELECT {_cols(S.COMPANY_ID, S.POSTCODES)} FROM {CO} WHERE {S.POSTCODES} IS NOT NULL")))
def drop_unlisted(spark, sf_dir):
    return C.drop_unlisted(_fx(spark, sf_dir).company()).select(S.COMPANY_ID, S.POSTCODES)


# ---- U: split / unpivot ----------------------------------------------------------------------
@register("explode_sites", O.with_ctes(["sites"], (
    f"SELECT {_cols(S.COMPANY_ID, S.POSTCODE, S.NO_SITES, *PER_SITE)} FROM sites")))
def explode_sites(spark, sf_dir):
    return X.explode_sites(_fx(spark, sf_dir).company()).select(S.COMPANY_ID, S.POSTCODE, S.NO_SITES, *PER_SITE)


@register("explode_sites_long_cells", O.with_ctes(["sites"], (
    f"SELECT {_cols(S.COMPANY_ID, S.POSTCODE, S.NO_SITES, *PER_SITE)} FROM sites")))
def explode_sites_long_cells(spark, sf_dir):
    """U1 for list cells of any length, spread over tasks."""
    rows = X.explode_sites(_fx(spark, sf_dir).company(), long_cells=True)
    return rows.select(S.COMPANY_ID, S.POSTCODE, S.NO_SITES, *PER_SITE)


@register("explode_las", O.with_ctes(["la_rows"], (
    f"SELECT {_cols(S.COMPANY_ID, S.LACODE, S.NO_LAS, *PER_LA)} FROM la_rows")))
def explode_las(spark, sf_dir):
    return X.explode_las(_fx(spark, sf_dir).company()).select(S.COMPANY_ID, S.LACODE, S.NO_LAS, *PER_LA)


@register("max_list_width", O.with_ctes([CC], (
    f"SELECT max({S.NO_SITES}) AS max_sites, max({S.NO_LAS}) AS max_las FROM {CC}")))
def max_list_width(spark, sf_dir):
    return X.max_list_width(_fx(spark, sf_dir).company())


@register("unpivot_wide_list", O.with_ctes(["sites"], f"SELECT {_cols(S.COMPANY_ID, S.POSTCODE)} FROM sites"))
def unpivot_wide_list(spark, sf_dir):
    """U4: separate into positions and lengthen, at any list width."""
    return X.sites_by_position(_fx(spark, sf_dir).company()).select(S.COMPANY_ID, S.POSTCODE)


# ---- J: joins ----------------------------------------------------------------------------------
@register("join_registered_postcode", O.with_ctes(["reg_located"], (
    f"SELECT {_cols(S.COMPANY_ID, S.REG_POSTCODE, S.LADCD)} FROM reg_located")))
def join_registered_postcode(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = L.join_postcode(L.registered_rows(fx.company_long()), fx.geography, S.REG_POSTCODE)
    return rows.select(S.COMPANY_ID, S.REG_POSTCODE, S.LADCD)


@register("join_la_region", O.with_ctes(["reg_located"], (
    f"SELECT {_cols(S.COMPANY_ID, S.LADCD, S.LAD23NM, S.RGN23CD, S.RGN23NM)} FROM reg_located")))
def join_la_region(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = L.locate_rows(fx.company_long(), fx.geography, L.REGISTERED)
    return rows.select(S.COMPANY_ID, S.LADCD, S.LAD23NM, S.RGN23CD, S.RGN23NM)


def _itl_sql(view: str) -> str:
    return O.with_ctes(["reg_located", view], (
        f"SELECT t.{S.COMPANY_ID} AS {S.COMPANY_ID}, t.ladcd AS ladcd, i.ITL221CD AS ITL221CD, "
        f"i.ITL221NM AS ITL221NM FROM reg_located t LEFT JOIN {view} i ON t.ladcd = i.LAD23CD"))


@register("join_itl_raw", _itl_sql("itl_raw"))
def join_itl_raw(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = L.join_postcode(L.registered_rows(fx.company_long()), fx.geography, S.REG_POSTCODE)
    return L.join_itl(rows, fx.geography, raw=True).select(S.COMPANY_ID, S.LADCD, S.ITL221CD, S.ITL221NM)


@register("join_itl", _itl_sql("itl_dedup"))
def join_itl(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = L.join_postcode(L.registered_rows(fx.company_long()), fx.geography, S.REG_POSTCODE)
    return L.join_itl(rows, fx.geography).select(S.COMPANY_ID, S.LADCD, S.ITL221CD, S.ITL221NM)


@register("join_site_postcode", O.with_ctes(["sites_located"], (
    f"SELECT {_cols(S.COMPANY_ID, S.POSTCODE, S.LADCD)} FROM sites_located")))
def join_site_postcode(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = L.join_postcode(X.explode_sites(fx.company()), fx.geography, S.POSTCODE)
    return rows.select(S.COMPANY_ID, S.POSTCODE, S.LADCD)


@register("join_site_postcode_long_cells", O.with_ctes(["sites_located"], (
    f"SELECT {_cols(S.COMPANY_ID, S.POSTCODE, S.LADCD)} FROM sites_located")))
def join_site_postcode_long_cells(spark, sf_dir):
    """J5 on list cells of any length."""
    fx = _fx(spark, sf_dir)
    rows = L.join_postcode(X.explode_sites(fx.company(), long_cells=True), fx.geography, S.POSTCODE)
    return rows.select(S.COMPANY_ID, S.POSTCODE, S.LADCD)


def _site_places(fx):
    """Company number and postcode of every site, from the long form."""
    ids = fx.company_long().select(S.COMPANY_KEY, S.COMPANY_ID)
    return join_companies(fx.site_pairs(), ids, fx.site_pairs()).select(S.COMPANY_ID, S.POSTCODE)


@register("join_site_coordinates", O.with_ctes(["sites", "fx_coord"], (
    f"SELECT s.{S.COMPANY_ID} AS {S.COMPANY_ID}, s.{S.POSTCODE} AS {S.POSTCODE}, c.oslaua AS oslaua, "
    f"c.pcon AS pcon, c.lat AS lat, c.long AS long, c.lep1 AS lep1 FROM sites s LEFT JOIN fx_coord c ON s.Postcode = c.pcds")))
def join_site_coordinates(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return L.join_coordinates(_site_places(fx), fx.geography).select(
        S.COMPANY_ID, S.POSTCODE, S.OSLAUA, S.PCON, S.LAT, S.LONG, S.LEP1)


@register("join_summary_region", _with_extra_cte(
    _area_ctes("la_code_totals") + ["la_region21"], {"h": _area_body("la_code_totals")},
    "SELECT h.LAcode AS LAcode, r.RGN21CD AS RGN21CD, r.RGN21NM AS RGN21NM, h.No_Companies AS No_Companies, "
    "h.GVA AS GVA, h.GVA_job AS GVA_job FROM h JOIN la_region21 r ON h.LAcode = r.LAD21CD"))
def join_summary_region(spark, sf_dir):
    """LA-code summary to its 2021 region (inner)."""
    fx = _fx(spark, sf_dir)
    t = area(fx, AREA["la_code_totals"])
    lr = fx.geography.la_regions21()
    j = t.join(lr, t[S.LACODE] == lr[S.LAD21CD], "inner").drop(lr[S.LAD21CD])
    return j.select(S.LACODE, S.RGN21CD, S.RGN21NM, S.NO_COMPANIES, S.OUT_GVA, S.GVA_JOB)


@register("join_summary_boundary", _with_extra_cte(
    _area_ctes("la_code_totals") + ["lad_boundary21"], {"h": _area_body("la_code_totals")},
    "SELECT h.LAcode AS LAcode, b.LAD21NM AS LAD21NM, b.geometry AS geometry, h.No_Companies AS No_Companies, "
    "h.GVA_job AS GVA_job FROM h JOIN lad_boundary21 b ON h.LAcode = b.LAD21CD"))
def join_summary_boundary(spark, sf_dir):
    """LA-code summary to its 2021 boundary (inner)."""
    fx = _fx(spark, sf_dir)
    t = area(fx, AREA["la_code_totals"])
    b = fx.geography.lad_boundary21
    j = t.join(b, t[S.LACODE] == b[S.LAD21CD], "inner").drop(b[S.LAD21CD])
    return j.select(S.LACODE, S.LAD21NM, S.GEOMETRY, S.NO_COMPANIES, S.GVA_JOB)


@register("join_sites_boundary", O.with_ctes(["sites_located", "fx_lad_boundary"], (
    f"SELECT s.{S.COMPANY_ID} AS {S.COMPANY_ID}, s.{S.POSTCODE} AS {S.POSTCODE}, s.ladcd AS ladcd, "
    f"b.LAD23NM AS boundary_LAD23NM, b.geometry AS geometry "
    f"FROM sites_located s LEFT JOIN fx_lad_boundary b ON s.ladcd = b.LAD23CD")))
def join_sites_boundary(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = L.join_postcode(_site_places(fx), fx.geography, S.POSTCODE)
    return L.join_sites_boundary(rows, fx.geography).select(
        S.COMPANY_ID, S.POSTCODE, S.LADCD, "boundary_" + S.LAD23NM, S.GEOMETRY)


_TOT = [S.NO_COMPANIES, S.OUT_GVA, S.OUT_TURNOVER, S.OUT_EMPLOYEES, S.OUT_INNOVATE, S.OUT_DEALROOM]


@register("map_join_national", _with_extra_cte(
    _area_ctes("la_registered_totals") + ["fx_lad_boundary"], {"s": _area_body("la_registered_totals")},
    "SELECT b.LAD23NM AS LAD23NM, b.LAD23CD AS LAD23CD, b.geometry AS geometry, "
    + ", ".join(f"s.{c} AS {c}" for c in _TOT) + " FROM fx_lad_boundary b LEFT JOIN s ON b.LAD23NM = s.LAD23NM"))
def map_join_national(spark, sf_dir):
    """Every boundary area; the unmatched (NULL) summary row cannot match and drops."""
    fx = _fx(spark, sf_dir)
    s = area(fx, AREA["la_registered_totals"])
    return fx.geography.lad_boundary.join(s, on=S.LAD23NM, how="left")


@register("map_join_north", _with_extra_cte(
    _area_ctes("north_la_registered_totals") + ["fx_lad_boundary"],
    {"s": _area_body("north_la_registered_totals")},
    "SELECT s.LAD23NM AS LAD23NM, " + ", ".join(f"s.{c} AS {c}" for c in _TOT)
    + ", b.LAD23CD AS LAD23CD, b.geometry AS geometry FROM s LEFT JOIN fx_lad_boundary b ON s.LAD23NM = b.LAD23NM"))
def map_join_north(spark, sf_dir):
    """Every northern summary area with its boundary."""
    fx = _fx(spark, sf_dir)
    s = area(fx, AREA["north_la_registered_totals"])
    return s.join(fx.geography.lad_boundary, on=S.LAD23NM, how="left")


_UNIQ = [("postcodes", "fx_postcode", S.PCDS), ("wards", "fx_ward_lookup", S.LAD23CD),
         ("coordinates", "fx_coord", S.PCDS), ("wards21", "fx_ward_lookup21", S.LAD21CD), ("itl", "fx_itl_lookup", S.LAD23CD),
         ("la_regions", "la_region", S.LAD23CD), ("lad_boundary", "fx_lad_boundary", S.LAD23NM),
         ("itl2_boundary", "fx_itl2_boundary", S.ITL221NM)]


@register("lookup_uniqueness_check", O.with_ctes([v for _, v, _ in _UNIQ], "\nUNION ALL\n".join(
    f"SELECT '{n}' AS lookup, '{k}' AS key, count(*) AS keys, count(*) FILTER (WHERE rows > 1) AS duplicate_keys, "
    f"CAST(coalesce(sum(rows - 1) FILTER (WHERE rows > 1), 0) AS BIGINT) AS extra_rows "
    f"FROM (SELECT {k}, count(*) AS rows FROM {v} GROUP BY {k}) t" for n, v, k in _UNIQ)))
def lookup_uniqueness_check(spark, sf_dir):
    """How many keys of each lookup have more than one row (the fan-out guard)."""
    g = _fx(spark, sf_dir).geography
    return uniqueness_report({
        "postcodes": (g.postcodes, S.PCDS), "coordinates": (g.coordinates, S.PCDS), "wards": (g.wards, S.LAD23CD),
        "wards21": (g.wards21, S.LAD21CD), "itl": (g.itl, S.LAD23CD),
        "la_regions": (g.la_regions(), S.LAD23CD), "lad_boundary": (g.lad_boundary, S.LAD23NM),
        "itl2_boundary": (g.itl2_boundary, S.ITL221NM)})


# ---- D: distinct ------------------------------------------------------------------------------
@register("distinct_lookup", O.with_ctes(["la_region"], f"SELECT {_cols(S.LAD23CD, S.LAD23NM, S.RGN23CD, S.RGN23NM)} FROM la_region"))
def distinct_lookup_query(spark, sf_dir):
    return _fx(spark, sf_dir).geography.la_regions()


@register("distinct_after_fanout", _with_extra_cte(
    _area_ctes("la_code_totals") + ["fx_ward_lookup21", "lad_boundary21"], {"h": _area_body("la_code_totals")},
    "SELECT DISTINCT h.LAcode AS LAcode, h.No_Companies AS No_Companies, h.GVA AS GVA, h.Turnover AS Turnover, "
    "h.Employees AS Employees, h.GVA_job AS GVA_job, h.InnovateFunding AS InnovateFunding, "
    "h.DealroomFunding AS DealroomFunding, w.RGN21CD AS RGN21CD, w.RGN21NM AS RGN21NM, b.LAD21NM AS LAD21NM, "
    "b.geometry AS geometry FROM h JOIN fx_ward_lookup21 w ON h.LAcode = w.LAD21CD "
    "JOIN lad_boundary21 b ON h.LAcode = b.LAD21CD"))
def distinct_after_fanout(spark, sf_dir):
    """D-2: the reference's order -- join the ward-grain lookup (rows fan out), then distinct."""
    fx = _fx(spark, sf_dir)
    t = area(fx, AREA["la_code_totals"])
    w = fx.geography.wards21.select(S.LAD21CD, S.RGN21CD, S.RGN21NM)   # ward grain, not distinct
    b = fx.geography.lad_boundary21
    j = (t.join(w, t[S.LACODE] == w[S.LAD21CD], "inner").drop(w[S.LAD21CD])
         .join(b, t[S.LACODE] == b[S.LAD21CD], "inner").drop(b[S.LAD21CD]))
    return j.distinct()


_SITE_ROW = [S.COMPANY_ID, S.COMPANY_NAME, S.EMPLOYEES, S.GVA, S.TURNOVER, S.LA_CODES, S.NO_SITES, *PER_SITE,
             S.POSTCODE]


@register("distinct_company_sites", O.with_ctes(["sites"], f"SELECT DISTINCT {_cols(*_SITE_ROW)} FROM sites"))
def distinct_company_sites(spark, sf_dir):
    """D-3: repeated site rows removed, compared over every column the reference keeps."""
    fx = _fx(spark, sf_dir)
    return site_pair_rows(fx.company_long(), fx.site_pairs(), whole_rows=True).select(*_SITE_ROW)


# ---- the long form of the sites -------------------------------------------------------------
@register("site_rows_long_form", O.with_ctes(["sites"], (
    f"SELECT {_cols(S.COMPANY_ID, S.COMPANY_NAME, S.POSTCODE, S.NO_SITES, *PER_SITE)}, count(*) AS repeats "
    f"FROM sites GROUP BY ALL")))
def site_rows_long_form(spark, sf_dir):
    """U1 and P7 without lists: a row per (company, site) and how often the company lists it."""
    fx = _fx(spark, sf_dir)
    rows = site_pair_rows(fx.company_long(), fx.site_pairs())
    return rows.select(S.COMPANY_ID, S.COMPANY_NAME, S.POSTCODE, S.NO_SITES, *PER_SITE,
                       F.col(WEIGHT).alias("repeats"))


@register("site_locations_long_form", O.with_ctes(["sites_located"], (
    f"SELECT {_cols(S.COMPANY_ID, S.COMPANY_NAME, S.POSTCODE, S.LADCD)}, count(*) AS repeats "
    f"FROM sites_located GROUP BY ALL")))
def site_locations_long_form(spark, sf_dir):
    """J5 without lists."""
    fx = _fx(spark, sf_dir)
    rows = L.join_postcode(site_pair_rows(fx.company_long(), fx.site_pairs()), fx.geography, S.POSTCODE)
    return rows.select(S.COMPANY_ID, S.COMPANY_NAME, S.POSTCODE, S.LADCD, F.col(WEIGHT).alias("repeats"))
