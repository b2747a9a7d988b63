"""Every registered query against its oracle SQL (DuckDB), compared exactly.

Row count, column names and the multiset of rows must be equal; doubles are compared bit
for bit (the oracle sums plain decimals).
"""

from __future__ import annotations

import math
from collections import Counter

import pytest

import __spark_entry__ as E
from areastats.plans.registry import QUERIES, SQL

NAMES = sorted(QUERIES)


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def test_every_query_has_oracle_sql():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(E.queries())
    assert len(NAMES) == 121


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, oracle, name):
    df = E.queries()[name](spark, sf_dir)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = oracle.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in want]
    assert len(got) == len(want)
    assert Counter(tuple(map(_norm, r)) for r in got) == Counter(tuple(map(_norm, r)) for r in want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["LAD23NM", "No_sites"]
    assert len(rows) > 0
