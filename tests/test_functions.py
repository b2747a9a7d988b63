"""Unit tests of the scalar and aggregate building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from areastats import schemas as S
from areastats.functions.lists import count_by_length, count_items, list_items
from areastats.functions.measures import (from_units, round_half_up, skip_null_sum, strict_sum,
                                          to_units)
from areastats.sources.names import snake_case


def test_count_items_keeps_empty_elements_and_nulls(spark):
    df = spark.createDataFrame([("a,b,c",), ("",), ("a,,b",), (None,), ("x",)], "l string")
    got = [r[0] for r in df.select(count_items("l")).collect()]
    assert got == [3, 1, 3, None, 1]
    arr = [r[0] for r in df.select(list_items("l")).collect()]
    assert arr[2] == ["a", "", "b"]


def test_length_rule_overcounts_from_ten_codes(spark):
    # n nine-character codes joined by commas are 10n-1 characters long (trap T4)
    rows = [(",".join(f"E{i:08d}" for i in range(n)),) for n in (1, 9, 10, 11, 12, 13)]
    df = spark.createDataFrame(rows, "l string")
    got = [r[0] for r in df.select(count_by_length("l")).collect()]
    assert got == [1, 9, 11, 12, 13, 14]
    exact = [r[0] for r in df.select(count_items("l")).collect()]
    assert exact == [1, 9, 10, 11, 12, 13]


def test_units_are_exact_and_order_free(spark):
    vals = [0.1] * 10 + [1e9 + 0.37, -2.5, 1 / 3]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    a = df.repartition(1).agg(from_units(F.sum(to_units(F.col("x"))))).first()[0]
    b = df.repartition(7).agg(from_units(F.sum(to_units(F.col("x"))))).first()[0]
    assert a == b
    assert abs(a - sum(vals)) < 1e-6


def test_strict_and_skip_null_sums(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0), ("c", None)], "k string, x double")
    got = {r["k"]: (r["s"], r["n"]) for r in df.groupBy("k").agg(
        strict_sum(F.col("x")).alias("s"), skip_null_sum(F.col("x")).alias("n")).collect()}
    assert got["a"] == (None, 1.0)      # one NULL makes the strict sum NULL
    assert got["b"] == (5.0, 5.0)
    assert got["c"] == (None, 0.0)      # all-NULL group: strict NULL, skipping gives 0


def test_round_half_up(spark):
    df = spark.createDataFrame([(12.25,), (12.35,), (-0.5,), (7.0,)], "x double")
    got = [r[0] for r in df.select(round_half_up(F.col("x"), 1)).collect()]
    assert got[0] == 12.3 and got[3] == 7.0


def test_snake_case_names():
    assert snake_case(S.GVA) == "best_estimate_current_gva"
    assert snake_case(S.INNOVATE) == "total_innovate_uk_funding"
    assert snake_case(S.LAD23CD) == "lad23cd"
    assert snake_case(S.ITL221NM) == "itl221nm"
    assert snake_case(S.COMPANY_ID) == "companynumber"


def test_area_query_rejects_unknown_values():
    import pytest

    from areastats.plans.area import AreaQuery
    with pytest.raises(ValueError):
        AreaQuery(level="county")
    with pytest.raises(ValueError):
        AreaQuery(basis="sites", level="la_code")
    assert AreaQuery(basis="la_codes", level="la_code", metric="headline").level == "la_code"
