"""Registered source and sink queries.

Each writes a fixture table in the reference's file format to a new folder under the shared
folder (``spark.checkpoint.dir``), reads it back with the engine's reader and returns the
result, so the whole write -> read path runs on Spark over all rows.
"""

from __future__ import annotations

from .. import oracle as O
from .. import schemas as S
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as W
from ..sources.names import normalise_columns, snake_case
from . import report as RP
from .catalog import AREA, SQL, _area_body, _area_ctes, _fx, _with_extra_cte, area, register
from .catalog_reports import share_sql

_COMPANY_COLS = [f.name for f in S.COMPANY_SCHEMA.fields]


def _cols(*names: str) -> str:
    return ", ".join(f"{n} AS {n}" for n in names)


@register("scan_companies", O.with_ctes(["fx_company"], f"SELECT {_cols(*_COMPANY_COLS)} FROM fx_company"))
def scan_companies(spark, sf_dir):
    """The company table written as CSV (NULL as NA), read back typed."""
    path = W.write_csv(_fx(spark, sf_dir).company(), scratch_path(spark, "companies_csv"))
    return R.scan_companies(spark, path, id_type="bigint")


@register("scan_postcode_lookup", O.with_ctes(["fx_postcode"], f"SELECT {_cols(S.PCD7, S.PCD8, S.PCDS, S.LADCD, S.LADNM)} FROM fx_postcode"))
def scan_postcode_lookup(spark, sf_dir):
    path = W.write_csv(_fx(spark, sf_dir).postcode(), scratch_path(spark, "postcodes_csv"))
    return R.scan_postcode_lookup(spark, path)


@register("scan_postcode_coordinates", O.with_ctes(["fx_coord"], f"SELECT {_cols(S.PCDS, S.OSLAUA, S.PCON, S.LAT, S.LONG, S.LEP1)} FROM fx_coord"))
def scan_postcode_coordinates(spark, sf_dir):
    path = W.write_csv(_fx(spark, sf_dir).coordinates(), scratch_path(spark, "coordinates_csv"))
    return R.scan_postcode_coordinates(spark, path)


@register("scan_region_lookup", O.with_ctes(["la_region"], f"SELECT {_cols(S.LAD23CD, S.LAD23NM, S.RGN23CD, S.RGN23NM)} FROM la_region"))
def scan_region_lookup(spark, sf_dir):
    """The ward file (ward grain) read and reduced to LA grain."""
    path = W.write_csv(_fx(spark, sf_dir).ward_lookup(), scratch_path(spark, "wards_csv"))
    return R.scan_region_lookup(spark, path)


@register("scan_itl_lookup", O.with_ctes(["itl_dedup"], f"SELECT {_cols(S.LAD23CD, S.ITL221CD, S.ITL221NM)} FROM itl_dedup"))
def scan_itl_lookup(spark, sf_dir):
    path = W.write_csv(_fx(spark, sf_dir).itl_lookup(), scratch_path(spark, "itl_csv"))
    return R.scan_itl_lookup(spark, path)


@register("scan_region_lookup21", O.with_ctes(["fx_ward_lookup21"], f"SELECT DISTINCT {_cols(S.LAD21CD, S.RGN21CD, S.RGN21NM)} FROM fx_ward_lookup21"))
def scan_region_lookup21(spark, sf_dir):
    """S4, 2021 vintage: the ward file reduced to LA grain."""
    path = W.write_csv(_fx(spark, sf_dir).ward_lookup21(), scratch_path(spark, "wards21_csv"))
    return R.scan_region_lookup(spark, path, (S.LAD21CD, S.RGN21CD, S.RGN21NM))


def _boundary_query(view: str, columns: list[str], sequence: bool):
    def run(spark, sf_dir):
        b = getattr(_fx(spark, sf_dir), view)()
        path = W.write_geojson(b, scratch_path(spark, view + "_geojson"), columns, sequence=sequence)
        return R.scan_boundaries(spark, path, columns, sequence=sequence)
    return run


# Boundary layers written as GeoJSON (a sequence of features; one collection), read back one row per area
for _name, _view, _cte, _columns in (
        ("scan_boundaries", "lad_boundary", "fx_lad_boundary", [S.LAD23CD, S.LAD23NM]),
        ("scan_boundaries21", "lad_boundary21", "lad_boundary21", [S.LAD21CD, S.LAD21NM]),
        ("scan_itl2_boundaries", "itl2_boundary", "fx_itl2_boundary", [S.ITL221CD, S.ITL221NM])):
    for _form, _sequence in (("", True), ("_collection", False)):
        register(_name + _form, O.with_ctes([_cte], f"SELECT {_cols(*_columns, S.GEOMETRY)} FROM {_cte}"))(
            _boundary_query(_view, _columns, _sequence))


@register("normalise_columns", O.with_ctes(["fx_company"], "SELECT " + ", ".join(
    f"{c} AS {snake_case(c)}" for c in _COMPANY_COLS) + " FROM fx_company"))
def normalise_columns_query(spark, sf_dir):
    """Snake-case column names (off by default in the readers, T1)."""
    return normalise_columns(_fx(spark, sf_dir).company())


@register("write_area_table", SQL["region_registered_totals"])
def write_area_table(spark, sf_dir):
    """The region table written as the reference writes it (BOM, header, NA), read back."""
    fx = _fx(spark, sf_dir)
    t = area(fx, AREA["region_registered_totals"])
    path = W.write_area_table(t, scratch_path(spark, "region_reg_address_csv"), single_file=True)
    raw = R.read_text_csv(spark, path)
    raw = raw.toDF(*[c.lstrip(W.BOM) for c in raw.columns])
    numeric = {c: ("bigint" if c == S.NO_COMPANIES else "double") for c in raw.columns if c != S.RGN23NM}
    return R.typed(raw, numeric)


@register("write_area_table_parts", (
    "SELECT row_number() OVER (ORDER BY LAD23NM NULLS LAST) AS line, * FROM (" + SQL["la_registered_totals"] + ")"))
def write_area_table_parts(spark, sf_dir):
    """S8 in several parts: the LA table in the order of its key over all of them, read back with
    every row's place."""
    t = area(_fx(spark, sf_dir), AREA["la_registered_totals"])
    path = W.write_area_table(t, scratch_path(spark, "la_reg_address_parts"))
    numeric = {"line": "bigint", **{c: k for c, k in t.dtypes if c != S.LAD23NM}}
    return R.typed(R.read_ordered_parts(spark, path, t.columns), numeric)


_FMT_COLS = [S.NO_SITES, S.OUT_GVA, S.OUT_TURNOVER, S.OUT_EMPLOYEES, S.OUT_INNOVATE, S.OUT_DEALROOM]


@register("read_formatted_table", _with_extra_cte(
    _area_ctes("region_sites_totals"), {"t": _area_body("region_sites_totals")},
    "SELECT RGN23NM AS RGN23NM, " + ", ".join(
        f"floor(CAST({c} AS DOUBLE) + 0.5) AS {c}" for c in _FMT_COLS) + " FROM t"))
def read_formatted_table(spark, sf_dir):
    """The region table as a spreadsheet re-saves it (`` 3,212 ``, `` -   ``), parsed back."""
    fx = _fx(spark, sf_dir)
    t = area(fx, AREA["region_sites_totals"])
    path = W.write_formatted_table(t, scratch_path(spark, "regions_all_sites_fmt"), S.RGN23NM)
    return R.read_formatted_table(spark, path, S.RGN23NM)


_PERCENT = ", ".join(f"{c} AS {c}" for c in _FMT_COLS)


@register("read_formatted_sections", _with_extra_cte(
    _area_ctes("region_sites_totals"),
    {"t": _area_body("region_sites_totals"), "p": f"SELECT * FROM ({share_sql(ctes=False)})"},
    "SELECT CAST(0 AS INTEGER) AS section, RGN23NM AS RGN23NM, " + ", ".join(
        f"floor(CAST({c} AS DOUBLE) + 0.5) AS {c}" for c in _FMT_COLS) + " FROM t\nUNION ALL\n"
    f"SELECT 1, RGN23NM, {_PERCENT} FROM p"))
def read_formatted_sections(spark, sf_dir):
    """A result file with stacked sections (totals, then percentages), parsed back."""
    fx = _fx(spark, sf_dir)
    q = AREA["region_sites_totals"]
    given = {"site_pairs": fx.site_pairs()}
    totals = W.formatted_table(area(fx, q), S.RGN23NM)
    shares = W.formatted_table(RP.share_of_total(fx.company_long(), fx.geography, q, **given), S.RGN23NM, digits=1)
    path = W.write_sections([totals, shares], scratch_path(spark, "regions_all_sites_sections"), S.RGN23NM)
    return R.read_formatted_sections(spark, path, [S.RGN23NM, *_FMT_COLS])
