"""Plan properties that must hold at any scale."""

from __future__ import annotations

import pytest

from areastats.plans.registry import QUERIES
from areastats.plans.area import AreaQuery, area_table
from areastats import schemas as S
from areastats.session import scratch_path
from areastats.sources.fixtures import fixtures

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_join_and_no_python_udf(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert not [k for k in FORBIDDEN if k in plan]


def _fact_scans(plan: str, table: str) -> int:
    return sum(1 for line in plan.splitlines() if "FileScan parquet" in line and f"/{table}.parquet" in line)


@pytest.mark.parametrize("name", ["la_registered_totals", "la_sites_totals", "itl2_registered_totals_raw"])
def test_facts_are_aggregated_by_location_before_any_lookup(spark, sf_dir, name):
    """One plan at any size: no broadcast hint, a partial aggregate by postcode below the join."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution()
    assert "ResolvedHint" not in plan.analyzed().toString() and "UnresolvedHint" not in plan.analyzed().toString()
    text = plan.executedPlan().toString()
    place = "Postcode" if "sites" in name else "Registeredpostcode"
    assert f"Exchange hashpartitioning({place}" in text and "partial_count" in text or "partial_sum" in text


def test_building_a_query_runs_no_job(spark, sf_dir):
    """Every registered query but the file round trips builds without a Spark job."""
    from areastats.sources.fixtures import Fixtures, _SHARED

    writes = {n for n in QUERIES if n.startswith(("scan_", "read_formatted", "write_"))}
    _SHARED.clear()
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for name in sorted(set(QUERIES) - writes):
        QUERIES[name](spark, sf_dir)
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert Fixtures(spark, sf_dir).company_long() is not None


def test_share_of_total_reads_the_facts_once(spark, sf_dir):
    plan = _plan(QUERIES["share_of_total"](spark, sf_dir))
    single = _plan(QUERIES["region_sites_totals"](spark, sf_dir))
    for t in ("lineitem", "orders"):
        assert _fact_scans(plan, t) == _fact_scans(single, t)


def test_total_row_expands_areas_not_facts(spark, sf_dir):
    plan = _plan(QUERIES["with_total_row"](spark, sf_dir)).splitlines()
    at = next(i for i, line in enumerate(plan) if "Expand" in line)
    below = next(line for line in plan[at + 1:] if "Aggregate" in line)
    assert "RGN23NM" in below                        # the input of Expand is already one row per area


def test_positive_filter_reaches_the_scan(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    path = scratch_path(spark, "companies")
    fx.company().write.parquet(path)
    companies = spark.read.schema(S.COMPANY_SCHEMA).parquet(path)
    df = area_table(companies, fx.geography, AreaQuery(basis="sites", level="la", metric="gva_per_job"))
    plan = _plan(df)
    scan = [l for l in plan.splitlines() if "FileScan parquet" in l and "Postcodes" in l][0]
    assert "PushedFilters: [IsNotNull(BestEstimateCurrentGVA)" in scan or "GreaterThan" in scan
