"""Registered report (R1-R7) and map-layer (M1-M17, D-4) queries."""

from __future__ import annotations

from dataclasses import replace

from .. import oracle as O
from .. import schemas as S
from . import layers as M
from . import report as RP
from .area import LEVELS, AreaQuery
from .catalog import AREA, SQL, _area_body, _area_ctes, _fx, _with_extra_cte, area, area_sql, register, NORTH_SQL

_TOTALS = [S.OUT_GVA, S.OUT_TURNOVER, S.OUT_EMPLOYEES, S.OUT_INNOVATE, S.OUT_DEALROOM]


def _value_columns(q: AreaQuery) -> list[tuple[str, str]]:
    """(name, zero literal) of the measure columns of an area table."""
    count = q.count_name or {"sites": S.NO_SITES}.get(q.basis, S.NO_COMPANIES)
    if q.metric == "gva_per_job":
        count = q.count_name or S.NO_COMPANIES
        return [(count, "0"), (S.GVA_PER_JOB, "0.0")]
    return [(count, "0")] + [(m, "0.0") for m in _TOTALS]


# ---- R: report operators -----------------------------------------------------------------
@register("with_total_row", area_sql(AREA["region_sites_totals"], rollup=True))
def with_total_row(spark, sf_dir):
    """Region totals over all sites with a Total row (unmatched area included)."""
    fx = _fx(spark, sf_dir)
    return RP.with_total_row(fx.company_long(), fx.geography, AREA["region_sites_totals"],
                             site_pairs=fx.site_pairs())


@register("with_total_row_matched", area_sql(AREA["region_sites_totals"], rollup=True, matched=True))
def with_total_row_matched(spark, sf_dir):
    """The same without the unmatched area; the total covers the matched areas."""
    fx = _fx(spark, sf_dir)
    return RP.with_total_row(fx.company_long(), fx.geography, AREA["region_sites_totals"],
                             include_unmatched=False, site_pairs=fx.site_pairs())


_SHARE_COLS = [S.NO_SITES] + _TOTALS


def share_sql(ctes: bool = True) -> str:
    """R2 in SQL; without ``ctes`` the body alone, over a CTE ``t`` of the area table."""
    tot = ", ".join(f"CAST(sum({O.pounds(c)}) AS DOUBLE) AS {c}" for c in _SHARE_COLS)
    shares = ", ".join(
        f"floor(100.0 * (CAST(m.{c} AS DOUBLE) / nullif(tot.{c}, 0)) * 10.0 + 0.5) / 10.0 AS {c}"
        for c in _SHARE_COLS)
    hundreds = ", ".join(f"100.0 AS {c}" for c in _SHARE_COLS)
    matched = "(SELECT * FROM t WHERE RGN23NM IS NOT NULL)"
    body = (f"SELECT m.RGN23NM AS RGN23NM, {shares} FROM {matched} m, (SELECT {tot} FROM {matched}) tot\n"
            f"UNION ALL\nSELECT 'Total' AS RGN23NM, {hundreds}")
    return _with_extra_cte(_area_ctes("region_sites_totals"), {"t": _area_body("region_sites_totals")}, body) if ctes else body


@register("share_of_total", share_sql())
def share_of_total(spark, sf_dir):
    """R2: each region's share (%, 1 decimal) of the matched total, plus Total = 100."""
    fx = _fx(spark, sf_dir)
    return RP.share_of_total(fx.company_long(), fx.geography, AREA["region_sites_totals"],
                             site_pairs=fx.site_pairs())


@register("coverage_ratio", O.with_ctes(["sites_located"], (
    "SELECT count(*) AS No_sites, count(RGN23NM) AS matched_sites, "
    "CAST(count(RGN23NM) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) AS coverage FROM sites_located")))
def coverage_ratio(spark, sf_dir):
    """Matched sites / all sites."""
    fx = _fx(spark, sf_dir)
    return RP.coverage_ratio(fx.company_long(), fx.geography, site_pairs=fx.site_pairs())


@register("ratio_to_national", _with_extra_cte(
    _area_ctes("la_sites_gva_per_job") + _area_ctes("national_gva_per_job"),
    {"t": _area_body("la_sites_gva_per_job"), "n": _area_body("national_gva_per_job")},
    "SELECT t.LAD23NM AS LAD23NM, t.No_Companies AS No_Companies, t.GVAPerJob AS GVAPerJob, "
    "t.GVAPerJob / nullif(n.GVAPerJob, 0) AS ratio_to_national FROM t, n"))
def ratio_to_national(spark, sf_dir):
    """LA GVA per job over all sites against the national (registered) GVA per job."""
    fx = _fx(spark, sf_dir)
    return RP.ratio_to_national(area(fx, AREA["la_sites_gva_per_job"]), area(fx, AREA["national_gva_per_job"]))


@register("sort_by_ratio", SQL["la_sites_gva_per_job"].replace("ORDER BY LAD23NM NULLS LAST",
                                                                "ORDER BY GVAPerJob NULLS LAST"))
def sort_by_ratio(spark, sf_dir):
    """Areas in ascending GVA per job."""
    fx = _fx(spark, sf_dir)
    return RP.sort_by_ratio(area(fx, AREA["la_sites_gva_per_job"]))


@register("drop_unmatched_area", _with_extra_cte(
    _area_ctes("region_sites_totals"), {"t": _area_body("region_sites_totals")},
    "SELECT * FROM t WHERE RGN23NM IS NOT NULL"))
def drop_unmatched_area(spark, sf_dir):
    """The region table over all sites without the unmatched area."""
    fx = _fx(spark, sf_dir)
    return RP.drop_unmatched_area(area(fx, AREA["region_sites_totals"]), S.RGN23NM)


@register("key_order", SQL["itl2_sites_totals"])
def key_order(spark, sf_dir):
    """The ITL2 table over all sites, by key with the unmatched area last."""
    fx = _fx(spark, sf_dir)
    return RP.key_order(area(fx, AREA["itl2_sites_totals"]), S.ITL221NM)


# ---- M: map layers ----------------------------------------------------------------------------
def _layer_sql(q: AreaQuery) -> str:
    key = LEVELS[q.level]
    boundary, code = (("fx_lad_boundary", S.LAD23CD) if q.level == "la"
                      else ("fx_itl2_boundary", S.ITL221CD))
    vals = _value_columns(q)
    filled = ", ".join(f"coalesce(s.{c}, {z}) AS {c}" for c, z in vals)
    if q.scope == "all":
        body = (f"SELECT DISTINCT b.{key} AS {key}, b.{code} AS {code}, b.geometry AS geometry, {filled} "
                f"FROM {boundary} b LEFT JOIN s ON b.{key} = s.{key}")
    else:
        body = (f"SELECT DISTINCT s.{key} AS {key}, {filled}, b.{code} AS {code}, b.geometry AS geometry "
                f"FROM s LEFT JOIN {boundary} b ON s.{key} = b.{key}")
    return _with_extra_cte(_area_ctes(q) + [boundary], {"s": _area_body(q)}, body)


def _layer_query(q: AreaQuery):
    def run(spark, sf_dir):
        fx = _fx(spark, sf_dir)
        return M.area_layer(fx.company_long(), fx.geography, q, site_pairs=fx.site_pairs())
    return run


NORTH_ITL2_REGISTERED = AreaQuery(level="itl2", scope="north")   # corrected lookup (J4)

LAYERS = {
    "map_la_registered": AREA["la_registered_totals"],
    "map_la_registered_gva_per_job": AREA["la_registered_gva_per_job"],
    "map_north_la_registered": AREA["north_la_registered_totals"],
    "map_north_la_registered_gva_per_job": AREA["north_la_registered_gva_per_job"],
    "map_itl2_registered": AREA["itl2_registered_totals"],
    "map_itl2_registered_gva_per_job": AREA["itl2_registered_gva_per_job"],
    "map_north_itl2_registered": NORTH_ITL2_REGISTERED,
    "map_north_itl2_registered_gva_per_job": replace(NORTH_ITL2_REGISTERED, metric="gva_per_job"),
    "map_la_sites": AREA["la_sites_totals"],
    "map_la_sites_gva_per_job": AREA["la_sites_gva_per_job"],
    "map_north_la_sites": AREA["north_la_sites_totals"],
    "map_north_la_sites_gva_per_job": AREA["north_la_sites_gva_per_job"],
    "map_itl2_sites": AREA["itl2_sites_totals"],
    "map_itl2_sites_gva_per_job": AREA["itl2_sites_gva_per_job"],
    "map_north_itl2_sites": AREA["north_itl2_sites_totals"],
    "map_north_itl2_sites_gva_per_job": AREA["north_itl2_sites_gva_per_job"],
}

for _name, _q in LAYERS.items():
    register(_name, _layer_sql(_q))(_layer_query(_q))


@register("distinct_map_rows", _layer_sql(AREA["la_sites_totals"]).replace(
    "FROM fx_lad_boundary b LEFT", "FROM (SELECT * FROM fx_lad_boundary UNION ALL SELECT * FROM fx_lad_boundary) b LEFT"))
def distinct_map_rows(spark, sf_dir):
    """D-4: the distinct map frame, from a boundary file that lists its areas twice."""
    fx = _fx(spark, sf_dir)
    b = fx.geography.lad_boundary
    return M.map_layer(area(fx, AREA["la_sites_totals"]), b.unionAll(b), S.LAD23NM)


_HEADLINE_LAYER = _with_extra_cte(
    ["la_rows", "la_region21", "lad_boundary21"], {"h": _area_body("la_code_totals")},
    "SELECT DISTINCT b.LAD21NM AS LAD21NM, r.RGN21NM AS RGN21NM, h.GVA_job AS GVA_job, b.geometry AS geometry "
    "FROM h JOIN la_region21 r ON h.LAcode = r.LAD21CD JOIN lad_boundary21 b ON h.LAcode = b.LAD21CD")


@register("map_headline_gva_job", _HEADLINE_LAYER)
def map_headline_gva_job(spark, sf_dir):
    """Headline GVA per job with the 2021 LA geometry."""
    fx = _fx(spark, sf_dir)
    return M.headline_layer(fx.company_long(), fx.geography)


@register("map_headline_gva_job_north", _HEADLINE_LAYER + f" WHERE r.RGN21CD IN {NORTH_SQL}")
def map_headline_gva_job_north(spark, sf_dir):
    """Its northern layer."""
    fx = _fx(spark, sf_dir)
    return M.headline_layer(fx.company_long(), fx.geography, north=True)
