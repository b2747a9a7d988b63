"""Invariants that hold in the published results, checked on the test tables (exactly)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from areastats import schemas as S
from areastats.functions.measures import from_units, to_units
from areastats.operators.lookups import NORTH_REGION_CODES
from areastats.plans.area import area_table
from areastats.plans.catalog import AREA
from areastats.plans.layers import area_layer
from areastats.sources.fixtures import fixtures


@pytest.fixture(scope="module")
def env(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    c, g = fx.company(), fx.geography            # list form; the registered queries use long form
    cache = {}

    def t(name):
        if name not in cache:
            cache[name] = {(r[0] if len(r) > 0 else None): r.asDict()
                           for r in area_table(c, g, AREA[name]).collect()}
        return cache[name]
    return fx, c, g, t


def _sum(rows, col):
    return sum(r[col] for r in rows.values())


def _exact_sum(spark, rows, col):
    df = spark.createDataFrame([(float(r[col]),) for r in rows.values()], "x double")
    return df.agg(from_units(F.sum(to_units(F.col("x"))))).first()[0]


def test_region_la_national_agree(spark, env):
    _, _, _, t = env
    nat = list(t("national_totals").values())[0]
    for name in ("region_registered_totals", "la_registered_totals"):
        rows = t(name)
        assert _sum(rows, S.NO_COMPANIES) == nat[S.NO_COMPANIES]
        assert _exact_sum(spark, rows, S.OUT_GVA) == nat[S.OUT_GVA]


def test_unmatched_group_is_the_same_at_every_level(env):
    _, _, _, t = env
    assert t("region_registered_totals")[None][S.NO_COMPANIES] == t("la_registered_totals")[None][S.NO_COMPANIES]
    assert t("la_sites_totals")[None][S.NO_SITES] == t("itl2_sites_totals")[None][S.NO_SITES]


def test_site_totals_agree_across_levels(env):
    fx, c, _, t = env
    sites = c.select(F.explode(F.split(S.POSTCODES, ",", -1))).count()
    assert _sum(t("la_sites_totals"), S.NO_SITES) == sites
    assert _sum(t("itl2_sites_totals"), S.NO_SITES) == sites


def test_north_tables_are_the_north_rows_of_the_full_tables(env):
    _, _, g, t = env
    north_las = {r[S.LAD23NM] for r in g.la_regions().filter(
        F.col(S.RGN23CD).isin(*NORTH_REGION_CODES)).collect()}
    for full, north in (("la_registered_totals", "north_la_registered_totals"),
                        ("la_sites_totals", "north_la_sites_totals")):
        want = {k: v for k, v in t(full).items() if k in north_las}
        assert t(north) == want


def test_north_las_sum_to_the_three_regions(env):
    _, _, g, t = env
    north_names = {r[S.RGN23NM] for r in g.la_regions().filter(
        F.col(S.RGN23CD).isin(*NORTH_REGION_CODES)).collect()}
    regions = t("region_registered_totals")
    assert _sum(t("north_la_registered_totals"), S.NO_COMPANIES) == sum(
        regions[n][S.NO_COMPANIES] for n in north_names)


def test_apportioning_conserves_listed_totals(spark, env):
    _, c, _, t = env
    listed = c.filter(F.col(S.POSTCODES).isNotNull())
    want = listed.agg(from_units(F.sum(to_units(F.col(S.GVA))))).first()[0]
    n_sites = _sum(t("la_sites_totals"), S.NO_SITES)
    got = _exact_sum(spark, t("la_sites_totals"), S.OUT_GVA)
    assert abs(got - want) <= 0.5e-6 * n_sites          # each site rounds to a micro-unit


def test_raw_itl_join_inflates_counts_and_the_corrected_one_does_not(env):
    _, _, _, t = env
    nat = list(t("national_totals").values())[0][S.NO_COMPANIES]
    assert _sum(t("itl2_registered_totals_raw"), S.NO_COMPANIES) > nat
    assert _sum(t("itl2_registered_totals"), S.NO_COMPANIES) == nat


def test_ratio_table_areas_and_zero_filled_layer(env):
    fx, c, g, t = env
    assert set(t("la_registered_gva_per_job")) <= set(t("la_registered_totals"))
    layer = {r[S.LAD23NM]: r for r in area_layer(c, g, AREA["la_registered_totals"]).collect()}
    boundary_names = {r[S.LAD23NM] for r in g.lad_boundary.collect()}
    assert set(layer) == boundary_names                  # every boundary, no NULL area
    empty = [n for n in boundary_names if n.startswith("EMPTY_")]
    assert empty and all(layer[n][S.NO_COMPANIES] == 0 and layer[n][S.OUT_GVA] == 0.0 for n in empty)
