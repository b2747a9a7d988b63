"""Long-form sites give exactly the area tables of exploding the list strings."""

from __future__ import annotations

import pytest

from areastats.plans.area import area_table
from areastats.plans.catalog import AREA
from areastats.sources.fixtures import Fixtures

SITE_QUERIES = [n for n, q in AREA.items() if q.basis == "sites"]


@pytest.mark.parametrize("name", SITE_QUERIES)
def test_pairs_equal_lists(spark, sf_dir, name):
    fx = Fixtures(spark, sf_dir)
    q = AREA[name]
    key = lambda r: (r[0] is None, r[0] or "")
    a = sorted((tuple(r) for r in area_table(fx.company(), fx.geography, q).collect()), key=key)
    b = sorted((tuple(r) for r in area_table(fx.company_long(), fx.geography, q,
                                             site_pairs=fx.site_pairs()).collect()), key=key)
    assert a == b
