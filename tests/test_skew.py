"""A company holding most of all sites: exact results, and the skew is absorbed before any join.

The long-form path first counts (company, postcode) pairs with a partial aggregation, so the
hot company reaches the company-keyed join with at most one row per distinct postcode; a
hot company with very many distinct postcodes is then split by AQE's skew join (settings
below make the join a shuffle join with tiny skew thresholds).
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import functions as F

from areastats import schemas as S
from areastats.plans.area import AreaQuery, area_table
from areastats.sources.fixtures import fixtures


def _units(x: float) -> int:
    return math.floor(x * 1e6 + 0.5)                  # positive amounts


def test_hot_company_long_form(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    pairs = fx.site_pairs()
    hot = pairs.agg(F.min(S.COMPANY_KEY)).first()[0]
    # every site postcode once more for one company: it now holds over half of all rows
    hot_pairs = pairs.unionByName(pairs.select(F.lit(hot).cast("bigint").alias(S.COMPANY_KEY),
                                               S.POSTCODE))
    q = AreaQuery(basis="sites", level="la")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = area_table(fx.company_long(), fx.geography, q, site_pairs=hot_pairs)
        got = {r[S.LAD23NM]: (r[S.NO_SITES], r[S.OUT_GVA]) for r in df.collect()}
        per_pair = hot_pairs.groupBy(S.COMPANY_KEY, S.POSTCODE).count()
        hot_rows = per_pair.filter(F.col(S.COMPANY_KEY) == hot).count()
        distinct_pc = hot_pairs.select(S.POSTCODE).distinct().count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    # the hot company enters the company-keyed join as at most one row per postcode
    assert hot_rows <= distinct_pc < hot_pairs.filter(F.col(S.COMPANY_KEY) == hot).count()

    # brute force in Python over the same inputs
    comp = {r[0]: r[1] for r in fx.company_long().select(S.COMPANY_KEY, S.GVA).collect()}
    pc_la = {r[0]: r[1] for r in fx.geography.postcode_to_la().collect()}
    la_nm = {r[0]: r[1] for r in fx.geography.la_regions().select(S.LAD23CD, S.LAD23NM).collect()}
    rows = [tuple(r) for r in hot_pairs.collect()]
    n_sites = defaultdict(int)
    for cid, _ in rows:
        n_sites[cid] += 1
    want_n, want_u = defaultdict(int), defaultdict(int)
    for cid, pc in rows:
        if cid not in comp:
            continue
        area = la_nm.get(pc_la.get(pc))
        want_n[area] += 1
        want_u[area] += _units(comp[cid] / n_sites[cid])
    assert {a: n for a, (n, _) in got.items()} == dict(want_n)
    assert {a: g for a, (_, g) in got.items()} == {a: u / 1e6 for a, u in want_u.items()}
