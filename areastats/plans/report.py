"""Report operators seen in the published result files.

Totals and shares are computed from the exact states of the areas, which are aggregated once;
national figures that every row is divided by are scalar subqueries (``DataFrame.scalar()``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.measures import final_value, from_units, round_half_up, safe_ratio, to_units
from ..operators.lookups import Geography
from ..operators.locate import BASES
from .area import (LEVELS, AreaQuery, area_rollup, area_states, area_table, rolled_states,
                   state_measures)


def with_total_row(companies: DataFrame, geo: Geography, q: AreaQuery,
                   include_unmatched: bool = True, **given) -> DataFrame:
    """The area table plus a ``Total`` row (with or without the unmatched area)."""
    return area_rollup(companies, geo, q, matched_only=not include_unmatched, **given)


def add_total_row(table: DataFrame, key: str, measures: list[str],
                  total_label: str = "Total") -> DataFrame:
    """R1 on an area table that is already aggregated: ``rollup`` over the key with exact
    sums; ``grouping()`` separates the total from a NULL area."""
    types = dict(table.dtypes)
    aggs = [(F.sum(m) if types[m] in ("bigint", "int") else
             from_units(F.sum(to_units(F.col(m).cast("double"))))).alias(m) for m in measures]
    rolled = table.rollup(key).agg(*aggs, F.grouping(key).alias("_total"))
    label = F.when(F.col("_total") == 1, F.lit(total_label)).otherwise(F.col(key)).alias(key)
    return rolled.select(label, *measures)


def drop_unmatched_area(table: DataFrame, key: str) -> DataFrame:
    """The table without the NULL area."""
    return table.filter(F.col(key).isNotNull())


def share_of_total(companies: DataFrame, geo: Geography, q: AreaQuery, digits: int = 1,
                   total_label: str = "Total", **given) -> DataFrame:
    """R2: each measure as a percentage of its total over the matched areas, rounded half up
    to ``digits`` decimals, plus a ``Total`` row of 100.

    One pass over the facts: areas and their total come from one rollup of the area states,
    and the total reaches the areas by a window over those few rows.
    """
    key, kind = LEVELS[q.level], q.kind
    measures = state_measures(BASES[q.basis], kind)
    count = q.count_name or BASES[q.basis].count_name
    rolled = rolled_states(companies, geo, q, True, **given).select(
        key, "_total", F.col(f"{kind}_n").cast("double").alias(count), *[final_value(m, kind) for m in measures])
    every = Window.partitionBy()
    names = [count] + [m.name for m in measures]
    total = {c: F.max(F.when(F.col("_total") == 1, F.col(c))).over(every) for c in names}
    shares = rolled.select(key, "_total", *[
        round_half_up(F.lit(100.0) * safe_ratio(F.col(c), total[c]), digits).alias(c) for c in names])
    is_total = F.col("_total") == 1
    return shares.select(F.when(is_total, F.lit(total_label)).otherwise(F.col(key)).alias(key), *[
        F.when(is_total, F.lit(100.0)).otherwise(F.col(c)).alias(c) for c in names])


def share_of_table(table: DataFrame, key: str, measures: list[str], digits: int = 1,
                   total_label: str = "Total") -> DataFrame:
    """R2 on an area table that is already aggregated."""
    rows = add_total_row(drop_unmatched_area(table, key), key, measures, total_label)
    is_total = F.col(key) == total_label
    every = Window.partitionBy()
    return rows.select(key, *[F.when(is_total, F.lit(100.0)).otherwise(round_half_up(F.lit(100.0) * safe_ratio(
        F.col(m).cast("double"), F.max(F.when(is_total, F.col(m).cast("double"))).over(every)), digits)).alias(m)
        for m in measures])


def coverage_ratio(companies: DataFrame, geo: Geography, **given) -> DataFrame:
    """Share of site rows whose region is known (matched sites / all sites)."""
    return coverage_of(area_states(companies, geo, AreaQuery(basis="sites", level="region"), **given))


def coverage_of(states: DataFrame) -> DataFrame:
    """R3 from states with their region (``t_n`` site rows each)."""
    return states.agg(F.sum("t_n").alias(S.NO_SITES),
                      F.coalesce(F.sum(F.when(F.col(S.RGN23NM).isNotNull(), F.col("t_n"))), F.lit(0))
                      .alias("matched_sites")).select(
        S.NO_SITES, "matched_sites",
        safe_ratio(F.col("matched_sites").cast("double"), F.col(S.NO_SITES).cast("double"))
        .alias("coverage"))


def ratio_to_national(table: DataFrame, national: DataFrame,
                      column: str = S.GVA_PER_JOB) -> DataFrame:
    """Each area's ratio divided by the national ratio (a scalar subquery)."""
    nat = national.select(F.col(column)).scalar()
    return table.withColumn("ratio_to_national", safe_ratio(F.col(column), nat))


def sort_by_ratio(table: DataFrame, column: str = S.GVA_PER_JOB) -> DataFrame:
    """Ascending by the ratio; the unmatched area sorts by its value like any other."""
    return table.orderBy(F.asc_nulls_last(column))


def key_order(table: DataFrame, key: str) -> DataFrame:
    """By key, NULL last."""
    return table.orderBy(F.asc_nulls_last(key))


__all__ = ["with_total_row", "drop_unmatched_area", "share_of_total", "coverage_ratio",
           "ratio_to_national", "sort_by_ratio", "key_order", "area_table"]
