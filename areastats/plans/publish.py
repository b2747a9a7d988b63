"""The whole job: every area table, report and map layer written as files.

The facts are read once per basis: ``publish`` computes three tables of location states
(registered addresses, sites, LA codes; all kinds of state in one pass), writes them to the
shared folder, and derives every output from them. Inputs are checked first (outputs whose
lookups are missing are skipped by name or refused, lookup keys must be unique), so nothing is
half written for want of a file. Each output declares its row order and is written as one CSV
in the reference's format (BOM, header, ``NA``, plain decimals); all are bounded by the number
of areas, so one file per table is one small task.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.lookups import Geography
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as W
from . import layers as M
from . import report as RP
from .area import LEVELS, AreaQuery, area_table, la_headlines, location_states

#: basis -> kinds of state its outputs need
STATES = {"registered": "tp", "sites": "tpd", "la_codes": "t"}


@dataclass(frozen=True)
class Output:
    """One published table: how it is built from the states, its row order, its lookups."""

    build: Callable[[dict[str, DataFrame], Geography], DataFrame]
    order: tuple[Column, ...]
    needs: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None       # where the order needs a column that isn't published


def _key_order(*keys: str) -> tuple[Column, ...]:
    return tuple(F.asc_nulls_last(k) for k in keys)


def _total_last(key: str) -> tuple[Column, ...]:
    """Areas by name, then the unmatched area, then the total."""
    return (F.asc(F.coalesce(F.col(key) == "Total", F.lit(False))), F.asc_nulls_last(key))


def _needs(q: AreaQuery) -> tuple[str, ...]:
    if q.level == "la_code" and q.scope == "all":
        return ()
    if q.level in ("la_code", "region21"):
        return ("wards21",) + (() if q.basis == "la_codes" else ("postcodes",))
    out = () if q.basis == "la_codes" or (q.level == "national" and q.scope == "all") else ("postcodes",)
    if q.level in ("region", "la") or q.scope == "north":
        out += ("wards",)
    return out + (("itl",) if q.level == "itl2" else ())


def tables() -> dict[str, Output]:
    """Output name -> how it is made."""
    from .catalog import AREA
    from .catalog_reports import LAYERS

    def area(q: AreaQuery):
        return lambda st, g: area_table(None, g, q, states=st[q.basis])

    by_ratio = (F.asc_nulls_last(S.GVA_PER_JOB), F.asc_nulls_last(S.LAD23NM))
    # the site-basis ratio tables are published in the order of their ratio
    ordered_by_ratio = {"la_sites_gva_per_job": by_ratio}
    out: dict[str, Output] = {}
    for name, q in AREA.items():
        key = LEVELS[q.level]
        out[name] = Output(area(q), ordered_by_ratio.get(name, _key_order(key) if key else ()), _needs(q))
    headline = ("wards21", "lad_boundary21")
    by_code = _key_order(S.LACODE)
    for name, north in (("national_la_headlines", False), ("northern_la_headlines", True)):
        out[name] = Output((lambda north: lambda st, g: la_headlines(None, g, north, states=st["la_codes"],
                                                                     code=True))(north),
                           by_code, headline, tuple(S.HEADLINE_COLUMNS))
    region = AREA["region_sites_totals"]
    both = ("postcodes", "wards")
    out["with_total_row"] = Output(lambda st, g: RP.with_total_row(None, g, region, states=st["sites"]),
                                   _total_last(S.RGN23NM), both)
    out["with_total_row_matched"] = Output(
        lambda st, g: RP.with_total_row(None, g, region, include_unmatched=False, states=st["sites"]),
        _total_last(S.RGN23NM), both)
    out["share_of_total"] = Output(lambda st, g: RP.share_of_total(None, g, region, states=st["sites"]),
                                   _total_last(S.RGN23NM), both)
    out["coverage_ratio"] = Output(lambda st, g: RP.coverage_ratio(None, g, states=st["sites"]), (), both)
    out["ratio_to_national"] = Output(lambda st, g: RP.ratio_to_national(
        area(AREA["la_sites_gva_per_job"])(st, g), area(AREA["national_gva_per_job"])(st, g)), by_ratio, both)
    for name, q in LAYERS.items():
        if name.startswith("map_"):
            boundary = "lad_boundary" if q.level == "la" else "itl2_boundary"
            out[name] = Output((lambda q: lambda st, g: M.area_layer(None, g, q, states=st[q.basis]))(q),
                               _key_order(LEVELS[q.level]), _needs(q) + (boundary,))
    for name, north in (("map_headline_gva_job", False), ("map_headline_gva_job_north", True)):
        out[name] = Output((lambda north: lambda st, g: M.headline_layer(None, g, north, states=st["la_codes"]))(north),
                           _key_order(S.LAD21NM), headline)
    return out


def write_states(companies: DataFrame, site_pairs: DataFrame | None = None,
                 bases: tuple[str, ...] = tuple(STATES)) -> dict[str, DataFrame]:
    """The state tables, each computed once and written to the shared folder."""
    spark = companies.sparkSession
    out = {}
    for basis in bases:
        states = location_states(companies, basis, STATES[basis], site_pairs if basis == "sites" else None)
        path = scratch_path(spark, f"states-{basis}")
        states.write.parquet(path)
        out[basis] = spark.read.schema(states.schema).parquet(path)
    return out


def missing_inputs(geo: Geography, names: list[str] | None = None) -> dict[str, list[str]]:
    """Outputs that can't be made -> the lookups they lack."""
    lacking = {n: [t for t in o.needs if not geo.has(t)] for n, o in tables().items() if names is None or n in names}
    return {n: v for n, v in lacking.items() if v}


def publish(companies: DataFrame, geo: Geography, out_dir: str, names: list[str] | None = None,
            site_pairs: DataFrame | None = None) -> dict[str, str]:
    """Write the named outputs (default: all whose lookups are given) under ``out_dir``.

    Returns name -> folder. Outputs that are named but lack a lookup are refused before
    anything is written; by default they are left out (``missing_inputs`` lists them).
    """
    outputs = tables()
    unknown = [n for n in names or [] if n not in outputs]
    if unknown:
        raise ValueError(f"unknown outputs: {unknown}")
    lacking = missing_inputs(geo, names)
    if names and lacking:
        raise ValueError(f"lookups missing: {lacking}")
    chosen = [n for n in names or outputs if n not in lacking]
    geo.check_keys()
    states = write_states(companies, site_pairs)
    written = {}
    for name in chosen:
        o = outputs[name]
        written[name] = W.write_area_table(o.build(states, geo), f"{out_dir.rstrip('/')}/{name}",
                                           single_file=True, order_by=o.order, columns=o.columns)
    return written


def load_inputs(spark: SparkSession, companies: str, postcodes: str, wards: str, itl: str,
                lad_boundaries: str, itl2_boundaries: str, wards21: str | None = None,
                lad21_boundaries: str | None = None, coordinates: str | None = None
                ) -> tuple[DataFrame, Geography]:
    """The reference's input files -> (company table, Geography)."""
    lookups = dict(
        postcodes=lambda: R.scan_postcode_lookup(spark, postcodes),
        wards=lambda: R.typed(R.read_text_csv(spark, wards)
                              .select(S.LAD23CD, S.LAD23NM, S.RGN23CD, S.RGN23NM), {}),
        itl=lambda: R.scan_itl_lookup(spark, itl, raw=True),
        lad_boundary=lambda: R.scan_boundaries(spark, lad_boundaries, [S.LAD23CD, S.LAD23NM]),
        itl2_boundary=lambda: R.scan_boundaries(spark, itl2_boundaries, [S.ITL221CD, S.ITL221NM]),
    )
    if wards21:
        lookups["wards21"] = lambda: R.typed(R.read_text_csv(spark, wards21)
                                             .select(S.LAD21CD, S.RGN21CD, S.RGN21NM), {})
    if lad21_boundaries:
        lookups["lad_boundary21"] = lambda: R.scan_boundaries(spark, lad21_boundaries, [S.LAD21CD, S.LAD21NM])
    if coordinates:
        lookups["coordinates"] = lambda: R.scan_postcode_coordinates(spark, coordinates)
    return R.scan_companies(spark, companies), Geography(**lookups)
