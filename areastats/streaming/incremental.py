"""Area tables kept up to date while company files arrive (Structured Streaming).

The reference works on yearly snapshots; this module runs the same area query over a
folder that receives new company files. Lookups are static DataFrames (stream-static
joins); the only stateful operator is the aggregation by area, whose state is one row per
area, so it stays small however many companies arrive. Output mode ``complete`` (or
``update``) re-emits the area rows that changed.

The batch plans pre-aggregate by postcode before joining; a streaming query may hold only
one aggregation in these output modes, so here the located rows are joined first (the
lookups are static and small) and aggregated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.measures import partial_state
from ..operators.company import positive
from ..operators.locate import BASES, join_itl, join_la_region, join_postcode
from ..operators.lookups import NORTH_REGION_CODES, Geography
from ..plans.area import LEVELS, AreaQuery, _finalize, state_measures


def read_company_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None
                        ) -> DataFrame:
    """New parquet files of the company table under ``path``, as a stream."""
    r = spark.readStream.schema(S.COMPANY_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def streaming_area_table(companies: DataFrame, geo: Geography, q: AreaQuery) -> DataFrame:
    """The area table of ``q`` over a streaming company DataFrame (one aggregation)."""
    if q.distinct_sites:
        raise ValueError("distinct_sites needs unbounded de-duplication state; "
                         "run that query in batch")
    basis = BASES[q.basis]
    key = LEVELS[q.level]
    rows = basis.rows(companies)
    if q.metric == "gva_per_job":
        rows = rows.filter(positive())
    if q.level in ("la_code", "region21") and (q.level == "region21" or q.scope == "north"):
        rows = rows.withColumn(S.LADCD, F.col(basis.location)) if basis.located_by_la else \
            join_postcode(rows, geo, basis.location)
        lr = geo.la_regions21()
        rows = rows.join(lr, rows[S.LADCD] == lr[S.LAD21CD], "inner").drop(lr[S.LAD21CD])
        if q.scope == "north":
            rows = rows.filter(F.col(S.RGN21CD).isin(*NORTH_REGION_CODES))
    elif key not in (None, S.LACODE) or q.scope == "north":
        rows = join_postcode(rows, geo, basis.location) if not basis.located_by_la else \
            rows.withColumn(S.LADCD, F.col(basis.location))
        rows = join_la_region(rows, geo)
        if q.level == "itl2":
            rows = join_itl(rows, geo, raw=(q.itl == "raw"))
        if q.scope == "north":
            rows = rows.filter(F.col(S.RGN23CD).isin(*NORTH_REGION_CODES))
    grouped = rows.groupBy(key) if key else rows.groupBy()
    states = grouped.agg(*partial_state(state_measures(basis, q.kind), q.kind))
    return _finalize(states, key, q)


def start_area_stream(table: DataFrame, path: str, checkpoint: str, mode: str = "complete"):
    """Start the stream; each micro-batch writes the area table to ``path``/batch=<n>."""
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return (table.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
