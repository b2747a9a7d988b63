"""Sites given in long form: one row per (company row, site postcode).

The reference keeps a company's sites in one comma-joined string, so one company's sites
live in one row and are exploded by one task. When the sites are available in long form,
this path never builds or explodes a list:

1. sites per company = a count by company, partial on every task;
2. everything that depends on the company alone (per-site measures, their exact units, what
   tells a row from another) is worked out once per company, not per site;
3. pairs meet their company in the one exchange of fact size; the companies with most sites are
   dealt to several tasks (``hot_join``).

``pairs`` and the company table share the column ``company_key``, which identifies a company
row; company numbers may repeat or be missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .company import SITE_COLUMNS, apportion
from .hot_join import hot_keys, split_join

WEIGHT = "_k"
_ROW = "_row"


def site_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(S.COMPANY_KEY).agg(F.count(F.lit(1)).alias(S.NO_SITES))


def site_companies(companies: DataFrame, pairs: DataFrame) -> DataFrame:
    """The companies that have sites, with the number of sites and the per-site measures."""
    kept = [c for c in SITE_COLUMNS if c in companies.columns and c != S.POSTCODES]
    c = companies.select(S.COMPANY_KEY, *kept).join(site_counts(pairs), S.COMPANY_KEY)
    return apportion(c, S.NO_SITES, S.PER_SITE)


def join_companies(pairs: DataFrame, c: DataFrame, site_pairs: DataFrame) -> DataFrame:
    """``pairs`` (company, postcode and other columns) with the columns of ``c``, one row for each
    company; ``site_pairs`` tells which companies have most sites."""
    return split_join(pairs, c, S.COMPANY_KEY, hot_keys(site_counts(site_pairs), S.COMPANY_KEY, S.NO_SITES))


def row_identity(c: DataFrame) -> DataFrame:
    """``c`` with a 256-bit digest of every column the reference keeps (D-3): company rows that
    agree in all of them have one digest (0.0 and -0.0 agree, as do NULLs)."""
    kept = [x for x in (*SITE_COLUMNS, S.NO_SITES) if x in c.columns and x != S.POSTCODES]
    numbers = {f.name for f in c.schema if f.dataType.simpleString() in ("double", "float")}
    same = [(F.col(x) + F.lit(0.0)).alias(x) if x in numbers else F.col(x) for x in kept]
    return c.withColumn(_ROW, F.unhex(F.sha2(F.to_json(F.struct(*same)).cast("binary"), 256)))


def distinct_pairs(pairs: DataFrame, c: DataFrame, value: list[str]) -> DataFrame:
    """Distinct site rows: one row per (digest, postcode) with its ``WEIGHT``, the smallest
    company key and the columns ``value`` of ``c``. Only digests and those columns are shuffled."""
    rows = join_companies(pairs, row_identity(c).select(S.COMPANY_KEY, _ROW, *value), pairs)
    return rows.groupBy(_ROW, S.POSTCODE).agg(
        F.count(F.lit(1)).alias(WEIGHT), F.min(S.COMPANY_KEY).alias(S.COMPANY_KEY),
        *[F.first(v).alias(v) for v in value]).drop(_ROW)


def site_pair_rows(companies: DataFrame, pairs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Site rows with their weight (``WEIGHT``): per-site measures, whole-company GVA and jobs.

    ``whole_rows``: rows that agree in every column the reference keeps (D-3) become one row,
    whichever company rows they come from.
    """
    c = site_companies(companies, pairs)
    if whole_rows:
        distinct = distinct_pairs(pairs, c, [])
        return join_companies(distinct, c, pairs).drop(S.COMPANY_KEY)
    pc = pairs.groupBy(S.COMPANY_KEY, S.POSTCODE).agg(F.count(F.lit(1)).alias(WEIGHT))
    return join_companies(pc, c, pairs).drop(S.COMPANY_KEY)
