"""Row-level derived columns of the company table.

All of these are narrow projections: they stay inside one whole-stage-codegen span and
never move data between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.lists import count_by_length, count_items
from ..functions.measures import MILLION, safe_ratio

DEALROOM = "TotalDealroomFunding"   # fixed value: Dealroom funding in pounds

# The columns the site and LA scripts keep; the registered-address scripts keep
# REGISTERED_COLUMNS
SITE_COLUMNS = [S.COMPANY_ID, S.COMPANY_NAME, S.EMPLOYEES, S.GVA, S.TURNOVER, S.LA_CODES, S.POSTCODES,
                S.INNOVATE, S.DEALROOM_M]
REGISTERED_COLUMNS = [S.COMPANY_ID, S.COMPANY_NAME, S.REG_POSTCODE, S.EMPLOYEES, S.GVA, S.TURNOVER,
                      S.INNOVATE, S.DEALROOM_M]


def project_company_columns(companies: DataFrame, columns: list[str] = SITE_COLUMNS) -> DataFrame:
    """The columns a script keeps (column pruning reaches the scan)."""
    return companies.select(*columns)


def with_list_counts(companies: DataFrame) -> DataFrame:
    """No_sites, No_LAs (length rule) and their difference (one projection). A frame
    without site lists gets No_LAs alone."""
    las = count_by_length(S.LA_CODES)
    if S.POSTCODES not in companies.columns:
        return companies.withColumn(S.NO_LAS, las)
    sites = count_items(S.POSTCODES)
    d = sites - las
    keep = [c for c in companies.columns if c not in (S.NO_LAS, S.NO_SITES, S.DIFFERENCE)]
    return companies.select(
        *keep, las.alias(S.NO_LAS), sites.alias(S.NO_SITES),
        F.when(d != 0, d).when(d == 0, F.lit(0).cast("bigint")).alias(S.DIFFERENCE))


def null_to_zero_measures(companies: DataFrame) -> DataFrame:
    """P10: funding columns with NULL replaced by 0."""
    return companies.fillna(0.0, subset=[S.INNOVATE, S.DEALROOM_M])


def scale_millions(c: Column | str) -> Column:
    """Millions of pounds to pounds."""
    c = F.col(c) if isinstance(c, str) else c
    return c * F.lit(MILLION)


def gva_per_job_row(companies: DataFrame) -> DataFrame:
    """Per-company GVA per job (NULL where there are no jobs)."""
    return companies.withColumn(S.GVA_PER_JOB_ROW, safe_ratio(F.col(S.GVA), F.col(S.EMPLOYEES)))


def apportion(companies: DataFrame, divisor: str, names: dict[str, str]) -> DataFrame:
    """The five measures split evenly over ``divisor`` places (one projection).

    Funding is NULL->0 first (P10) and Dealroom is scaled to pounds (P11) before the split,
    as in the reference. A zero divisor gives NULL, not infinity (D1).
    """
    n = F.col(divisor)
    innovate = F.coalesce(F.col(S.INNOVATE), F.lit(0.0))
    dealroom = scale_millions(F.coalesce(F.col(S.DEALROOM_M), F.lit(0.0)))
    replaced = {S.INNOVATE: innovate.alias(S.INNOVATE),
                S.DEALROOM_M: F.coalesce(F.col(S.DEALROOM_M), F.lit(0.0)).alias(S.DEALROOM_M)}
    base = [replaced.get(c, F.col(c)) for c in companies.columns]
    return companies.select(
        *base, dealroom.alias(DEALROOM),
        safe_ratio(F.col(S.TURNOVER), n).alias(names["turnover"]),
        safe_ratio(F.col(S.GVA), n).alias(names["gva"]),
        safe_ratio(F.col(S.EMPLOYEES), n).alias(names["employees"]),
        safe_ratio(innovate, n).alias(names["innovate"]),
        safe_ratio(dealroom, n).alias(names["dealroom"]))


def apportion_per_site(companies: DataFrame) -> DataFrame:
    return apportion(with_list_counts(companies), S.NO_SITES, S.PER_SITE)


def apportion_per_la(companies: DataFrame) -> DataFrame:
    return apportion(with_list_counts(companies), S.NO_LAS, S.PER_LA)


def positive(gva: str = S.GVA, employees: str = S.EMPLOYEES) -> Column:
    """positive GVA and positive employment."""
    return (F.col(gva) > 0) & (F.col(employees) > 0)


def filter_positive(df: DataFrame) -> DataFrame:
    return df.filter(positive())


def drop_unlisted(companies: DataFrame, list_column: str = S.POSTCODES) -> DataFrame:
    """companies without a list take no part in list-based tables."""
    return companies.filter(F.col(list_column).isNotNull())
