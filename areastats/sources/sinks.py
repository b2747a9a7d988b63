"""Writers (S8, and the files the readers' tests read back).

``write_area_table`` produces what ``write_excel_csv`` produces: UTF-8 with a byte-order
mark, a header, ``NA`` for missing values. A single file needs a single task, so it is meant
for final area tables (bounded by the number of areas); ``single_file=False`` writes several
parts for anything larger, whose rows are ordered across the parts too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.measures import round_half_up

BOM = "﻿"


def plain_number(c: Column) -> Column:
    """A double as plain decimals (no exponent, no trailing zeros), exact to 18 decimals."""
    text = c.cast("string")
    exact = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.coalesce(F.regexp_replace(exact, r"\.$", ""), text)


def write_area_table(df: DataFrame, path: str, single_file: bool = False, bom: bool = True,
                     order_by: tuple[Column, ...] | None = None,
                     columns: tuple[str, ...] | None = None) -> str:
    """CSV with header, ``NA`` for NULL, plain decimals, strings written as they are (no
    trimming), quotes doubled inside quoted fields (RFC 4180, as R writes them).

    ``single_file`` writes one file in one task: for final area tables, which are bounded by
    the number of areas. ``order_by`` (default: the first column, NULL last) is the row order
    in the file; ``columns`` are the ones written (default: all). Without ``single_file`` rows
    are dealt to parts by ranges, so the order holds over the parts in the order of their names;
    rows that tie are dealt by their other columns, so a hot value takes as many parts as it needs."""
    order = order_by if order_by is not None else ((F.asc_nulls_last(df.columns[0]),) if df.columns else ())
    if single_file:
        out = df.coalesce(1)
        out = out.sortWithinPartitions(*order) if order else out
    else:
        ties = [F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        out = df.orderBy(*order, *ties) if order else df
    out = out.select(*[plain_number(F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes if columns is None or c in columns])
    if bom and out.columns:
        first = out.columns[0]
        out = out.withColumnRenamed(first, BOM + first)
    (out.write.mode("errorifexists").option("header", True).option("nullValue", "NA")
     .option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Plain headed CSV, NULL as ``NA`` (inputs for the readers)."""
    (df.write.mode("errorifexists").option("header", True).option("nullValue", "NA")
     .option("escape", '"').csv(path))
    return path


def format_spreadsheet_number(c, digits: int = 0):
    """How a spreadsheet shows a number: `` 3,212 ``; zero as `` -   ``. Rounded half up."""
    rounded = round_half_up(c.cast("double"), digits)
    return (F.when(rounded == 0, F.lit(" -   "))
            .otherwise(F.concat(F.lit(" "), F.format_number(rounded, digits), F.lit(" "))))


def formatted_table(df: DataFrame, key: str, digits: int = 0) -> DataFrame:
    """A result table's cells as a spreadsheet shows them."""
    return df.select(*[F.col(c) if c == key else format_spreadsheet_number(F.col(c), digits).alias(c)
                       for c in df.columns])


def write_formatted_table(df: DataFrame, path: str, key: str) -> str:
    """A result table as a spreadsheet re-saves it (the input of S9)."""
    out = formatted_table(df, key).coalesce(1).sortWithinPartitions(F.asc_nulls_last(key))
    return write_csv(out, path)


def write_geojson(df: DataFrame, path: str, properties: list[str],
                  geometry: str = S.GEOMETRY, sequence: bool = True) -> str:
    """Boundaries as GeoJSON. By default a sequence, one feature per line, in parallel;
    ``sequence=False`` writes one FeatureCollection document, line by line, in one task."""
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(F.struct(*[F.col(p) for p in properties])),
        F.lit(',"geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit("}"))
    feats = df.select(feature.alias("value"))
    if not sequence:
        line = F.monotonically_increasing_id()          # 0, 1, 2, ... in the one partition
        body = feats.coalesce(1).select(line.alias("line"), "value")
        body = body.select("line", F.when(F.col("line") > 0, F.concat(F.lit(","), "value"))
                           .otherwise(F.col("value")).alias("value"))
        frame = df.sparkSession.createDataFrame(
            [(-1, '{"type":"FeatureCollection","features":['), (1 << 62, "]}")], "line bigint, value string")
        feats = body.unionAll(frame).coalesce(1).sortWithinPartitions("line").select("value")
    feats.write.mode("errorifexists").text(path)
    return path


def write_sections(tables: list[DataFrame], path: str, key: str) -> str:
    """Area tables stacked in one file, as spreadsheets keep them: each under its own header
    row, a blank row between them (the input of ``read_formatted_sections``). Columns are
    matched by position."""
    lines = []
    for i, t in enumerate(tables):
        cells = [F.coalesce(F.col(c), F.lit("NA")) if c == key else F.col(c) for c in t.columns]
        frame = t.sparkSession.createDataFrame(
            [(i, 0, None, *["" for _ in t.columns]), (i, 1, None, *t.columns)] if i else [(i, 1, None, *t.columns)],
            "section int, part int, area string, " + ", ".join(f"c{j} string" for j in range(len(t.columns))))
        body = t.select(F.lit(i).alias("section"), F.lit(2).alias("part"), F.col(key).alias("area"),
                        *[c.cast("string").alias(f"c{j}") for j, c in enumerate(cells)])
        lines += [frame, body]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionAll(more)
    out = out.coalesce(1).sortWithinPartitions("section", "part", F.asc_nulls_last("area"))
    (out.drop("section", "part", "area").write.mode("errorifexists").option("header", False)
     .option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path
