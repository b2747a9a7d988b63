"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application.

    Needed where it isn't installed there; Spark's own file server carries it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_areastats_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="areastats-code-"), "areastats.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._areastats_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table under the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def every_column(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_in_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: the function sees and gives c0, c1, ..."""
    given = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    return given.mapInArrow(run, plain).toDF(*schema.names)


def batch_of(columns: list[pa.Array]) -> pa.RecordBatch:
    """A batch with the column names of ``map_in_arrow``."""
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` is ``remainder`` (a null id: false)."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(rest == F.lit(remainder), F.lit(False))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``: the same rows at every run.

    A share of rows is kept, ``rows`` of the number counted, so the expected size is bounded
    at every input size. Only for fitting models.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def distinct_sample(df: DataFrame, mark: str, rows: int) -> DataFrame:
    """The rows of about ``rows`` values of the hash column ``mark``: the same at every run.

    Repeated rows have one mark and count once, so a hot one neither empties nor fills the
    sample. ``capped`` afterwards makes the bound strict.
    """
    n = df.agg(F.approx_count_distinct(mark, 0.02)).first()[0]
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(mark, F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def capped(df: DataFrame, mark: str, rows: int) -> DataFrame:
    """One row of each ``mark``, at most ``rows`` of them, by a hash. For small rows."""
    return df.dropDuplicates([mark]).orderBy(F.xxhash64(mark, F.lit(17)), mark).limit(rows)
