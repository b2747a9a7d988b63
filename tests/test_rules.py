"""Scope, distinct rows, joins and sums against brute force on small hand-made tables."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from areastats import schemas as S
from areastats.functions.measures import from_units, to_units
from areastats.operators import explode as X
from areastats.operators import locate as L
from areastats.operators.lookups import Geography
from areastats.plans import report as RP
from areastats.plans.area import AreaQuery, area_table
from areastats.plans.publish import STATES, write_states

# number, name, registered postcode, GVA, turnover, jobs, Innovate, Dealroom, sites, LA codes
COMPANIES = [
    (1, "a", "P1", 100.0, 10.0, 2.0, None, 1e-6, "P1,P2,P1", "E00000001,E00000002"),
    (1, "b", "P2", 900.0, 20.0, 0.0, 5.0, None, "P1,P4", "E00000002"),       # number repeats
    (None, "c", "P3", 7.0, 30.0, 1.0, 6.0, None, "P3", "E00000003"),
    (None, "c", "P1", 7.0, 30.0, 1.0, 6.0, None, "P3", "E00000003"),        # the same site row as above
    (4, "d", None, 50.0, 40.0, 5.0, None, None, None, None),
    (5, "e", "P9", 60.0, 50.0, 6.0, 1.0, 2e-6, "P9,P1", "E00000004"),         # P9 is not listed
]
PLACES = {"P1": "E00000001", "P2": "E00000002", "P3": "E00000003", "P4": "E00000001"}
LAS = {"E00000001": ("one", "E12000001", "NORTH"), "E00000002": ("two", "E12000009", "SOUTH"),
       "E00000003": ("three", "E12000002", "NORTH WEST")}
NORTH = {"E12000001", "E12000002", "E12000003"}
ITL = {"E00000001": "I1", "E00000002": "I2", "E00000003": "I1"}


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Tables of six rows: compiling the plans would take longer than running them."""
    keys = ("spark.sql.codegen.wholeStage", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, ("false", "2")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def small(spark):
    c = spark.createDataFrame(COMPANIES, S.COMPANY_SCHEMA)
    wards = [(k, *v) for k, v in LAS.items()]
    return c, Geography(
        postcodes=spark.createDataFrame(list(PLACES.items()), "pcds string, ladcd string"),
        wards=spark.createDataFrame(wards, "LAD23CD string, LAD23NM string, RGN23CD string, RGN23NM string"),
        wards21=spark.createDataFrame(wards, "LAD21CD string, LAD21NM string, RGN21CD string, RGN21NM string"),
        itl=spark.createDataFrame([(k, v, v + "n") for k, v in ITL.items()],
                                  "LAD23CD string, ITL221CD string, ITL221NM string"))


def _rows(basis: str, distinct: bool):
    """(LA code, GVA part, turnover part, whole GVA, whole jobs) of every located row."""
    out = []
    for num, name, reg, gva, turnover, jobs, inn, deal, sites, las in COMPANIES:
        if basis == "registered":
            out.append((PLACES.get(reg), gva, turnover, gva, jobs))
        elif basis == "sites" and sites:
            places = sites.split(",")
            for p in places:
                out.append((PLACES.get(p), gva / len(places), turnover / len(places), gva, jobs,
                            (num, name, jobs, turnover, las, inn, deal, len(places), p)))
        elif basis == "la_codes" and las:
            codes = las.split(",")
            out += [(code, gva / len(codes), turnover / len(codes), gva, jobs) for code in codes]
    return list(dict.fromkeys(out)) if distinct else out


def _want(q: AreaQuery):
    areas: dict = {}
    for code, gva, turnover, whole, jobs, *_ in _rows(q.basis, q.distinct_sites):
        la = LAS.get(code)
        vintage21 = q.level in ("region21", "la_code")
        if q.scope == "north" and (la is None or la[1] not in NORTH):
            continue
        if q.level == "region21" and la is None:
            continue
        if q.metric == "gva_per_job" and not (whole > 0 and jobs > 0):
            continue
        key = {"national": (), "region": la and la[2], "la": la and la[0], "region21": la and la[2],
               "la_code": code, "itl2": ITL.get(code) and ITL[code] + "n"}[q.level]
        n, a, b = areas.get(key, (0, 0.0, 0.0))
        one, two = (whole, jobs) if q.metric == "gva_per_job" else (gva, turnover)
        areas[key] = (n + 1, a + one, b + two)
        del vintage21
    if q.level == "national" and not areas:
        areas[()] = (0, 0.0, 0.0)
    if q.metric == "gva_per_job":
        return {k: (n, round(a / b, 6)) for k, (n, a, b) in areas.items()}
    return {k: (n, round(a, 4), round(b, 4)) for k, (n, a, b) in areas.items()}


CELLS = [(b, lv, sc, m, d) for b, lv, sc, m, d in itertools.product(
    ("registered", "sites", "la_codes"), ("national", "region", "la", "itl2", "la_code", "region21"),
    ("all", "north"), ("totals", "gva_per_job"), (False, True))]


@pytest.mark.parametrize("basis,level,scope,metric,distinct", CELLS)
def test_every_cell_against_brute_force(small, basis, level, scope, metric, distinct):
    kw = dict(basis=basis, level=level, scope=scope, metric=metric, distinct_sites=distinct)
    possible = not (level == "la_code" and basis != "la_codes") and not (
        distinct and (basis != "sites" or metric == "gva_per_job"))
    if not possible:
        with pytest.raises(ValueError):
            AreaQuery(**kw)
        return
    q = AreaQuery(**kw)
    c, geo = small
    got = {}
    for r in area_table(c, geo, q).collect():
        r = list(r)
        key = () if level == "national" else r.pop(0)
        got[key] = (r[0], round(r[1], 6)) if metric == "gva_per_job" else (r[0], round(r[1], 4), round(r[2], 4))
    assert got == _want(q)


def test_states_in_one_pass_equal_the_single_queries(small):
    c, geo = small
    states = write_states(c)
    assert set(states) == set(STATES)
    for q in (AreaQuery(), AreaQuery(metric="gva_per_job"), AreaQuery(basis="sites", level="region"),
              AreaQuery(basis="sites", level="region", distinct_sites=True),
              AreaQuery(basis="sites", level="la", metric="gva_per_job"),
              AreaQuery(basis="la_codes", level="la_code", metric="headline", scope="north")):
        a = area_table(c, geo, q).collect()
        b = area_table(None, geo, q, states=states[q.basis]).collect()
        assert sorted(a, key=str) == sorted(b, key=str)


def test_distinct_keeps_different_rows_of_one_number(small):
    """Two companies of one number at one postcode are two rows; equal rows are one."""
    c, geo = small
    plain = {r[0]: r[1] for r in area_table(c, geo, AreaQuery(basis="sites", level="la")).collect()}
    once = {r[0]: r[1] for r in area_table(c, geo, AreaQuery(basis="sites", level="la", distinct_sites=True)).collect()}
    assert plain["one"] == 5 and once["one"] == 4           # P1 is listed twice by the first company
    assert plain["three"] == 2 and once["three"] == 1       # equal in every kept column


def test_directory_rows_that_differ_multiply_and_equal_ones_do_not(spark, small):
    c, geo = small
    base = list(PLACES.items())
    repeat = Geography(postcodes=spark.createDataFrame(base + [("P3", "E00000003")], "pcds string, ladcd string"),
                       wards=geo.wards)
    q = AreaQuery(basis="sites", level="la")
    assert {r[0]: r[1] for r in area_table(c, repeat, q).collect()}["three"] == 4
    d = AreaQuery(basis="sites", level="la", distinct_sites=True)
    assert {r[0]: r[1] for r in area_table(c, repeat, d).collect()}["three"] == 1
    with pytest.raises(ValueError, match="P3"):
        repeat.check_keys()


def test_coordinate_join_keeps_every_row(spark):
    rows = spark.createDataFrame([("P1",), ("P2",), (None,)], "Postcode string")
    geo = Geography(coordinates=spark.createDataFrame(
        [("P1", 1.0), ("P1", 2.0)], "pcds string, lat double"))
    got = sorted(map(str, (tuple(r) for r in L.join_coordinates(rows, geo).collect())))
    assert got == sorted(map(str, [("P1", 1.0), ("P1", 2.0), ("P2", None), (None, None)]))


def test_sums_do_not_saturate(spark):
    t = spark.createDataFrame([("a", 1e13), ("b", 5e13), ("c", 4e28)], "k string, x double")
    got = t.select(from_units(to_units(F.col("x")))).collect()
    assert [r[0] for r in got] == [1e13, 5e13, 4e28]
    total = {r[0]: r[1] for r in RP.add_total_row(t.where("k <> 'c'"), "k", ["x"]).collect()}
    assert total == {"a": 1e13, "b": 5e13, "Total": 6e13}
    share = spark.createDataFrame([("a", 1e13), ("b", 4e13)], "k string, x double")
    assert {r[0]: r[1] for r in RP.share_of_table(share, "k", ["x"]).collect()} == {"a": 20.0, "b": 80.0, "Total": 100.0}


@pytest.mark.parametrize("value", [float("nan"), float("inf"), -float("inf"), 1e32])
def test_values_that_cannot_be_summed_raise(spark, value):
    t = spark.createDataFrame([(value,), (1.0,)], "x double")
    with pytest.raises(Exception, match="not a summable value"):
        t.agg(F.sum(to_units(F.col("x")))).collect()


def test_ties_round_away_from_zero(spark):
    t = spark.createDataFrame([(0.0000005,), (-0.0000005,), (2.5e-6,), (-2.5e-6,)], "x double")
    assert [int(r[0]) for r in t.select(to_units(F.col("x"))).collect()] == [1, -1, 3, -3]


def test_wide_list_is_lengthened_without_a_column_per_position(spark):
    sites = ",".join(f"P{i}" for i in range(300)) + ",,P1"
    c = spark.createDataFrame([(1, "a", "P1", 1.0, 1.0, 1.0, None, None, sites, None)], S.COMPANY_SCHEMA)
    df = X.sites_by_position(c)
    assert "posexplode" in df._jdf.queryExecution().optimizedPlan().toString()
    a = sorted(r[0] for r in df.select(S.POSTCODE).collect())
    assert a == sorted(r[0] for r in X.explode_sites(c).select(S.POSTCODE).collect()) and len(a) == 302


def test_shared_folder_is_required_on_a_cluster(spark):
    from areastats.session import shared_dir

    class Conf:
        def __init__(self, **kv):
            self.kv = kv

        def get(self, k, default=None):
            return self.kv.get(k, default)

    class Session:
        def __init__(self, master, folder=None):
            self.conf = Conf(**{"spark.master": master}, **({"spark.checkpoint.dir": folder} if folder else {}))

        class sparkContext:  # noqa: N801
            @staticmethod
            def getCheckpointDir():
                return None

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(Session(master))
        assert shared_dir(Session(master, "/shared/x/")) == "/shared/x"
