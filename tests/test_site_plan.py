"""The plan of long-form sites: exchanges of the facts, hot companies, distinct rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from areastats import schemas as S
from areastats.operators import hot_join as H
from areastats.operators import locate as L
from areastats.operators import site_pairs as P
from areastats.plans.area import AreaQuery, area_table, location_states
from areastats.sources import readers as R
from areastats.sources.fixtures import fixtures


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffle_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "70k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_facts_move_once_before_the_postcode_exchange(spark, sf_dir, shuffle_joins):
    """Sites meet companies in one exchange by company; what moves else is counts or states."""
    fx = fixtures(spark, sf_dir)
    plan = _plan(location_states(fx.company_long(), "sites", "t", site_pairs=fx.site_pairs()))
    by_site = [line for line in plan.splitlines() if "Exchange hashpartitioning(company_key" in line]
    keyed = [line for line in by_site if "_split" in line]
    assert len(keyed) == 2                                   # the pairs and the companies
    assert sum("Exchange hashpartitioning(Postcode" in line for line in plan.splitlines()) == 1
    assert "Exchange hashpartitioning(company_key, Postcode" not in plan
    # below the other exchanges by company is a partial count or the company table
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(company_key" in line and "_split" not in line:
            assert "partial_count" in lines[i + 1] or "Company" in lines[i + 1] or "ReusedExchange" in line or \
                "BestEstimate" in lines[i + 1] or "Project" in lines[i + 1]


def test_hot_companies_are_dealt_to_several_tasks(spark, sf_dir, monkeypatch):
    fx = fixtures(spark, sf_dir)
    pairs = fx.site_pairs()
    hot = pairs.agg(F.min(S.COMPANY_KEY)).first()[0]
    pairs = pairs.unionAll(pairs.select(F.lit(hot).cast("bigint").alias(S.COMPANY_KEY), S.POSTCODE))
    queries = [AreaQuery(basis="sites", level="la"), AreaQuery(basis="sites", level="la", metric="gva_per_job"),
               AreaQuery(basis="sites", level="region", distinct_sites=True)]
    run = lambda q: sorted(map(str, area_table(fx.company_long(), fx.geography, q, site_pairs=pairs).collect()))
    whole = [run(q) for q in queries]
    monkeypatch.setattr(H, "HOT_ROWS", 50)
    assert [run(q) for q in queries] == whole
    parts = H.split_facts(pairs, S.COMPANY_KEY, H.hot_keys(P.site_counts(pairs), S.COMPANY_KEY, S.NO_SITES))
    sizes = [r["count"] for r in parts.where(F.col(S.COMPANY_KEY) == hot).groupBy(H.SPLIT).count().collect()]
    assert len(sizes) >= 8
    cold = parts.where(F.col(S.COMPANY_KEY) != hot).agg(F.max(H.SPLIT)).first()[0]
    assert cold == 0


def test_hot_postcode_and_area_joins(spark, monkeypatch):
    """A third of all rows on one postcode that repeats in the lookup: rows whole, tasks even."""
    monkeypatch.setattr(H, "HOT_ROWS", 500)
    n = 30_000
    rows = spark.range(n, numPartitions=6).select(
        F.col("id").alias(S.COMPANY_ID), F.when(F.col("id") % 3 == 0, F.lit("P0")).when(F.col("id") % 100 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("P"), F.col("id") % 700)).alias(S.POSTCODE))
    coords = [(f"P{i}", f"L{i % 9}", "c", float(k), 0.5, "l") for i in range(600) for k in range(2 + (i == 0))]
    coords += [(None, "L", "c", 1.0, 1.0, "l")]

    class Geo:
        coordinates = spark.createDataFrame(coords, f"{S.PCDS} string, {S.OSLAUA} string, {S.PCON} string, "
                                                    f"{S.LAT} double, {S.LONG} double, {S.LEP1} string")
        lad_boundary = spark.createDataFrame([(f"P{i}", f"N{i}", "{}" * 50) for i in range(9)],
                                             f"{S.LAD23CD} string, {S.LAD23NM} string, {S.GEOMETRY} string")

    conf = {"spark.sql.autoBroadcastJoinThreshold": "70k", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = L.join_coordinates(rows, Geo).withColumn("task", F.spark_partition_id())
        sizes = sorted(r["count"] for r in got.groupBy("task").count().collect())
        plain = rows.join(Geo.coordinates, rows[S.POSTCODE] == Geo.coordinates[S.PCDS], "left").drop(S.PCDS)
        cols = [S.COMPANY_ID, S.POSTCODE, S.OSLAUA, S.LAT]
        assert got.select(*cols).exceptAll(plain.select(*cols)).count() == 0
        assert got.count() == plain.count()
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        located = rows.withColumnRenamed(S.POSTCODE, S.LADCD)
        with_b = L.join_sites_boundary(located, Geo)
        assert with_b.count() == n and with_b.where(F.col(S.GEOMETRY).isNotNull()).count() == located.where(
            F.col(S.LADCD).isin(*[f"P{i}" for i in range(9)])).count()
        lines = _plan(with_b).splitlines()
        for i, line in enumerate(lines):                     # no geometry in an exchange of rows
            if "Exchange hashpartitioning(ladcd" in line and S.COMPANY_ID in "".join(lines[i + 1:i + 3]):
                assert S.GEOMETRY not in lines[i + 1]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_feature_collections_are_split(spark, tmp_path):
    """One document, several tasks, the same rows; white space, nested braces, a mark in a text."""
    features = [{"type": "Feature", "id": i, "properties": {"LAD23CD": f"E{i}", "LAD23NM": 'a "Feat}ure" {' + str(i)},
                 "geometry": {"type": "Polygon", "coordinates": [[[i, 1], [2, 3.5]]] * 40} if i % 7 else None}
                for i in range(400)]
    for name, indent in (("a", None), ("b", 2)):
        doc = {"type": "FeatureCollection", "crs": {"type": "name"}, "features": features}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        for name in "ab":
            df = R.scan_boundaries(spark, str(tmp_path / f"{name}.json"), ["LAD23CD", "LAD23NM"])
            assert df.rdd.getNumPartitions() > 3
            rows = {r.LAD23CD: r for r in df.collect()}
            assert len(rows) == 400 == df.count()
            for f in features:
                r = rows[f["properties"]["LAD23CD"]]
                assert r.LAD23NM == f["properties"]["LAD23NM"]
                assert (json.loads(r.geometry) if r.geometry else None) == f["geometry"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": "Feature"}, "geometry": None}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="not a feature"):
        R.scan_boundaries(spark, str(tmp_path / "c.json"), ["k"]).collect()
    (tmp_path / "d.json").write_text('{"type":"FeatureCollection","features":[]}')
    assert R.scan_boundaries(spark, str(tmp_path / "d.json"), ["k"]).count() == 0


def test_distinct_rows_shuffle_digests(spark, sf_dir, shuffle_joins):
    """D-3: no name, LA list or measure of the companies is shuffled with the sites."""
    fx = fixtures(spark, sf_dir)
    c = P.site_companies(fx.company_long(), fx.site_pairs())
    plan = _plan(P.distinct_pairs(fx.site_pairs(), c, []))
    head = plan.splitlines()
    at = next(i for i, line in enumerate(head) if "Exchange hashpartitioning(_row" in line)
    assert "partial_count" in head[at + 1] and S.COMPANY_NAME not in head[at + 1]


def test_row_identity_follows_every_kept_column(spark):
    rows = [(1, 7, "a", 0.0, 2), (2, 7, "a", -0.0, 2), (3, 7, "a", None, 2), (4, None, "a", 0.0, 2), (5, 7, "b", 0.0, 2),
            (6, 7, "a", 0.0, 3), (7, 7, None, 0.0, 2), (8, 7, "a", None, 2)]
    df = spark.createDataFrame(rows, f"{S.COMPANY_KEY} long, {S.COMPANY_ID} long, {S.COMPANY_NAME} string, "
                                     f"{S.GVA} double, {S.NO_SITES} long")
    got = {r[0]: bytes(r[1]) for r in P.row_identity(df).select(S.COMPANY_KEY, P._ROW).collect()}
    assert got[1] == got[2] and got[3] == got[8] and len(set(got.values())) == 6 and len(got[1]) == 32
