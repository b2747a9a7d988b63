"""The whole job, from the test tables and from input files in the reference's formats."""

from __future__ import annotations

import glob
import os

import pytest

from areastats import schemas as S
from areastats.operators.lookups import Geography
from areastats.plans.publish import STATES, load_inputs, publish, tables
from areastats.session import scratch_path
from areastats.sources import readers as R
from areastats.sources import sinks as W
from areastats.sources.fixtures import fixtures

CHECK = ["la_sites_totals", "region_sites_totals", "itl2_registered_totals_raw",
         "north_la_sites_gva_per_job", "northern_la_headlines", "map_la_sites", "with_total_row"]


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def _lines(path: str) -> list[str]:
    (part,) = glob.glob(os.path.join(_local(path), "part-*.csv"))
    with open(part, encoding="utf-8-sig") as f:
        return f.read().splitlines()


def _read(spark, path):
    df = R.read_text_csv(spark, path)
    return sorted(tuple(r) for r in df.toDF(*[c.lstrip(W.BOM) for c in df.columns]).collect())


@pytest.fixture(scope="module")
def written(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return publish(fx.company_long(), fx.geography, scratch_path(spark, "publish"), site_pairs=fx.site_pairs())


def test_every_output_is_one_file(written):
    assert set(written) == set(tables())
    for path in written.values():
        assert len(_lines(path)) >= 2


def test_numbers_are_plain(written):
    for name in ("region_registered_totals", "la_sites_totals"):
        assert not [line for line in _lines(written[name]) if "E7" in line or "E8" in line]


def test_row_orders_are_those_of_the_published_files(written):
    # ratios ascending over all sites; LA code for headlines; the total after the areas
    ratios = [float(line.rsplit(",", 1)[1]) for line in _lines(written["la_sites_gva_per_job"])[1:]]
    assert ratios == sorted(ratios)
    names = [line.split(",")[0] for line in _lines(written["with_total_row"])[1:]]
    assert names[-1] == "Total" and names[-2] == "NA" and names[:-2] == sorted(names[:-2])
    assert [x.split(",")[0] for x in _lines(written["share_of_total"])][-1] == "Total"
    las = [line.split(",")[0] for line in _lines(written["national_la_headlines"])[1:]]
    assert las == sorted(las, key=lambda n: int(n.split("_")[1])) and las != sorted(las)


def test_every_output_comes_from_three_state_tables(spark, sf_dir, monkeypatch):
    """The facts are read only while the state tables are written."""
    from areastats.plans import publish as P

    seen = []
    real = P.location_states
    monkeypatch.setattr(P, "location_states", lambda c, b, *a: seen.append(b) or real(c, b, *a))
    fx = fixtures(spark, sf_dir)
    states = P.write_states(fx.company_long(), fx.site_pairs())
    assert seen == list(STATES)
    for name, o in P.tables().items():
        plan = o.build(states, fx.geography)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem.parquet" not in plan and "orders.parquet" not in plan, name


def test_input_files_give_the_same_outputs(spark, sf_dir, written):
    fx = fixtures(spark, sf_dir)
    d = scratch_path(spark, "inputs")
    geojson = lambda b, name, cols: W.write_geojson(b, f"{d}/{name}", cols, sequence=False)
    files = {
        "companies": W.write_csv(fx.company(), f"{d}/companies"),
        "postcodes": W.write_csv(fx.postcode(), f"{d}/postcodes"),
        "wards": W.write_csv(fx.ward_lookup(), f"{d}/wards"),
        "wards21": W.write_csv(fx.ward_lookup21(), f"{d}/wards21"),
        "itl": W.write_csv(fx.itl_lookup(), f"{d}/itl"),
        "lad_boundaries": geojson(fx.lad_boundary(), "lad", [S.LAD23CD, S.LAD23NM]),
        "lad21_boundaries": geojson(fx.lad_boundary21(), "lad21", [S.LAD21CD, S.LAD21NM]),
        "itl2_boundaries": geojson(fx.itl2_boundary(), "itl2", [S.ITL221CD, S.ITL221NM]),
    }
    companies, geo = load_inputs(spark, **files)
    b = publish(companies, geo, scratch_path(spark, "pub_b"), CHECK)
    for name in CHECK:
        assert _read(spark, written[name]) == _read(spark, b[name]), name


def test_missing_lookups_are_found_before_writing(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    geo = Geography(postcodes=fx.postcode, wards=fx.ward_lookup, itl=fx.itl_lookup,
                    lad_boundary=fx.lad_boundary, itl2_boundary=fx.itl2_boundary)
    out = scratch_path(spark, "partial")
    with pytest.raises(ValueError, match="wards21"):
        publish(fx.company_long(), geo, out, ["la_sites_totals", "northern_la_headlines"], fx.site_pairs())
    assert not os.path.exists(_local(out))


def test_repeated_lookup_keys_are_refused(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    twice = fx.postcode().unionAll(fx.postcode().limit(1))
    geo = Geography(postcodes=twice, wards=fx.ward_lookup)
    with pytest.raises(ValueError, match="postcodes"):
        publish(fx.company_long(), geo, scratch_path(spark, "dup"), ["la_registered_totals"])
