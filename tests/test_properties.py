"""Property tests: apportioning conserves totals; results do not depend on partitioning."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from areastats import schemas as S
from areastats.operators import explode as X
from areastats.operators.lookups import Geography
from areastats.plans.area import AreaQuery, area_table

POSTCODES = ["PC000001", "PC000002", "PC000003", "PC000004", ""]
CODES = ["E00000001", "E00000002", "E00000003"]

company = st.tuples(
    st.floats(min_value=-1e6, max_value=1e9, allow_nan=False).map(lambda x: round(x, 2)),
    st.one_of(st.none(), st.lists(st.sampled_from(POSTCODES), min_size=1, max_size=13)),
)


def _companies(spark, rows):
    data = [(i, f"Company {i}", "RC00000001", g, 1.0, 1.0, None, None,
             None if pcs is None else ",".join(pcs), None) for i, (g, pcs) in enumerate(rows)]
    return spark.createDataFrame(data, S.COMPANY_SCHEMA)


def _geo(spark):
    pcs = spark.createDataFrame([(p, CODES[i % 3]) for i, p in enumerate(POSTCODES[:4])],
                                "pcds string, ladcd string")
    wards = spark.createDataFrame([(c, f"LA{c[-1]}", "E12000001", "NORTH") for c in CODES],
                                  "LAD23CD string, LAD23NM string, RGN23CD string, RGN23NM string")
    return Geography(postcodes=pcs, wards=wards)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(company, min_size=1, max_size=25))
def test_apportioning_conserves_listed_totals(spark, rows):
    c = _companies(spark, rows)
    sites = X.explode_sites(c)
    got = sites.agg(F.sum(S.PER_SITE["gva"])).first()[0] or 0.0
    want = sum(g for g, pcs in rows if pcs is not None)
    assert abs(got - want) <= 1e-6 * max(1.0, abs(want))
    assert sites.count() == sum(len(p) for _, p in rows if p is not None)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(company, min_size=1, max_size=25), st.integers(min_value=1, max_value=6))
def test_area_table_independent_of_partitioning(spark, rows, parts):
    c = _companies(spark, rows)
    geo = _geo(spark)
    q = AreaQuery(basis="sites", level="la")
    key = lambda r: (r[0] is None, r[0] or "")
    a = sorted((tuple(r) for r in area_table(c.repartition(1), geo, q).collect()), key=key)
    b = sorted((tuple(r) for r in area_table(c.repartition(parts), geo, q).collect()), key=key)
    assert a == b    # exact sums: same bits whatever the partitioning
