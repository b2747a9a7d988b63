"""A join on a key that may hold a large share of the facts.

``hot_keys`` lists the keys with most rows: at most ``HOT_KEYS`` of those with more than
``HOT_ROWS`` rows, a list small enough for the planner to send to every task (it needs no hint).
The facts of a listed key are dealt to ``SPLITS`` parts by a hash of the row and of the task that
read it, and the lookup rows of that key go to each part. A key that isn't listed has at most
``HOT_ROWS`` rows or less than one in ``HOT_KEYS`` of all, so no task gets a large share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000
HOT_KEYS = 4096
SPLITS = 64
HOT, SPLIT = "_hot", "_split"


def hot_keys(counts: DataFrame, key: str, rows: str) -> DataFrame:
    """The listed keys (column ``HOT``) of a table of counts by key."""
    return (counts.where(F.col(key).isNotNull() & (F.col(rows) > HOT_ROWS)).orderBy(F.desc(rows), key)
            .limit(HOT_KEYS).select(F.col(key).alias(HOT)))


def _with_split(df: DataFrame, key: str, hot: DataFrame, split: Column) -> DataFrame:
    marked = df.join(hot, F.col(key) == F.col(HOT), "left")
    return marked.withColumn(SPLIT, F.when(F.col(HOT).isNotNull(), split).otherwise(F.lit(0)))


def split_facts(facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The facts with the part (``SPLIT``) that each row is dealt to."""
    dealt = F.pmod(F.xxhash64(*facts.columns, F.spark_partition_id()), F.lit(SPLITS)).cast("int")
    return _with_split(facts, key, hot, dealt).drop(HOT)


def split_join(facts: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``facts`` joined to ``lookup`` on the column ``key`` of both, listed keys in parts."""
    every = _with_split(lookup, key, hot, F.lit(SPLITS - 1))
    every = every.drop(HOT).withColumn(SPLIT, F.explode(F.sequence(F.lit(0), SPLIT)))
    return split_facts(facts, key, hot).join(every, [key, SPLIT], how).drop(SPLIT)
