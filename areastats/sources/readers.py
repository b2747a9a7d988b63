"""Readers for the reference's input files.

CSV is read with inference off: every column arrives as text, then only the needed columns
are selected (the CSV scan prunes the rest), trimmed, ``""``/``"NA"`` turned into NULL and
numbers converted with ``try_cast`` -- what ``read_csv`` does, but declared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S

# fixed values: text that ``read_csv`` treats as missing
NA_STRINGS = ("", "NA")


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV with every column as text (no schema inference)."""
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def clean_text(c: Column) -> Column:
    """Trim, and map the missing markers to NULL."""
    t = F.trim(c)
    return F.when(t.isin(*NA_STRINGS), F.lit(None).cast("string")).otherwise(t)


def typed(df: DataFrame, numeric: dict[str, str]) -> DataFrame:
    """Clean every text column, then ``try_cast`` the listed ones to their types."""
    out = []
    for c in df.columns:
        v = clean_text(F.col(c))
        out.append((v.try_cast(numeric[c]) if c in numeric else v).alias(c))
    return df.select(*out)


def scan_companies(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """The company table, columns by the reference's names.

    Company numbers are kept as text by default (registered numbers can carry letters, as
    ``SC123456`` does); ``id_type="bigint"`` reads purely numeric ids as numbers."""
    raw = read_text_csv(spark, path)
    cols = [f.name for f in S.COMPANY_SCHEMA.fields]
    lacking = [c for c in cols if c not in raw.columns]
    if lacking:
        raise ValueError(f"company file lacks the columns {lacking}")
    numeric = {f.name: f.dataType.simpleString() for f in S.COMPANY_SCHEMA.fields
               if f.dataType.simpleString() != "string"}
    if id_type == "string":
        numeric.pop(S.COMPANY_ID, None)
    else:
        numeric[S.COMPANY_ID] = id_type
    return typed(raw.select(*cols), numeric)


def scan_postcode_lookup(spark: SparkSession, path: str,
                         columns: tuple[str, ...] = (S.PCD7, S.PCD8, S.PCDS, S.LADCD, S.LADNM)) -> DataFrame:
    """``read_csv`` + ``select(pcd7, pcd8, pcds, ladcd, ladnm)``; the registered-address
    scripts keep ``pcds, ladcd, ladnm``."""
    return typed(read_text_csv(spark, path).select(*columns), {})


def scan_postcode_coordinates(spark: SparkSession, path: str,
                              columns: tuple[str, ...] = (S.PCDS, S.OSLAUA, S.PCON, S.LAT, S.LONG, S.LEP1)
                              ) -> DataFrame:
    """S3: the coordinate file; lat/long as doubles."""
    return typed(read_text_csv(spark, path).select(*columns), {S.LAT: "double", S.LONG: "double"})


def scan_region_lookup(spark: SparkSession, path: str,
                       columns: tuple[str, ...] = (S.LAD23CD, S.LAD23NM, S.RGN23CD, S.RGN23NM)
                       ) -> DataFrame:
    """The ward file reduced to LA grain (``select`` + ``distinct``)."""
    return typed(read_text_csv(spark, path).select(*columns), {}).distinct()


def scan_itl_lookup(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """LA -> ITL2; de-duplicated unless ``raw``."""
    df = typed(read_text_csv(spark, path).select(S.LAD23CD, S.ITL221CD, S.ITL221NM), {})
    return df if raw else df.distinct()


FEATURE_SCHEMA = "type string, properties map<string, string>, geometry string"
#: A feature's type, as every feature of a collection has it once; the collection's own is another.
FEATURE = '"Feature"'


def collection_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of FeatureCollection documents, split inside a document.

    The text is read in records that end at each ``"Feature"``, so Spark deals one file to
    several tasks; what follows such a mark up to the end of its object is the rest of a feature
    (whose members may come in any layout, but ``type`` first). What the mark means can't be
    told where a property has the value ``Feature`` too; such a file raises, as does a feature
    that is no whole object. ``multiLine`` reading with one task a file is for those.
    """
    raw = spark.read.option("lineSep", FEATURE).text(path).select(F.col("value").alias("rest"))
    rest = raw.where(~F.ltrim(F.regexp_replace("rest", "^\ufeff", "")).startswith("{"))
    parsed = rest.select("rest", F.from_json(F.concat(F.lit('{"type":' + FEATURE), "rest"), FEATURE_SCHEMA + ", _bad string",
                                             {"columnNameOfCorruptRecord": "_bad"}).alias("f"))
    broken = F.col("f").isNull() | F.col("f._bad").isNotNull() | F.col("f.properties").isNull()
    bad = F.raise_error(F.concat(F.lit("not a feature of type, then other members: "), F.substring("rest", 1, 80)))
    checked = parsed.select(F.when(broken, bad.cast("struct<properties: map<string, string>, geometry: string>"))
                            .otherwise(F.struct("f.properties", "f.geometry")).alias("f"))
    return checked.select("f.properties", "f.geometry")


def scan_boundaries(spark: SparkSession, path: str, properties: list[str],
                    sequence: bool = False) -> DataFrame:
    """GeoJSON boundaries -> one row per area: the named properties + geometry as text.

    A FeatureCollection is one JSON document per file, split inside the document
    (``collection_features``). ``sequence=True`` reads newline-delimited features (GeoJSONSeq).
    """
    f = (spark.read.schema(FEATURE_SCHEMA).json(path) if sequence else collection_features(spark, path))
    return f.select(*[F.col("properties")[p].alias(p) for p in properties], S.GEOMETRY)


def read_formatted_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A result table re-saved by a spreadsheet: `` 3,212 `` -> 3212, `` -   `` -> 0,
    blank rows dropped. The key column stays text; the others become doubles."""
    raw = read_text_csv(spark, path)
    cols = []
    for c in raw.columns:
        v = clean_text(F.col(c))
        if c != key:
            v = (F.when(v.rlike(r"^-+$"), F.lit(0.0))
                 .otherwise(F.regexp_replace(v, ",", "").try_cast("double")))
        cols.append(v.alias(c))
    t = raw.select(*cols)
    return t.dropna(how="all")


def _parse_formatted_number(v: Column) -> Column:
    return (F.when(v.rlike(r"^-+$"), F.lit(0.0))
            .otherwise(F.regexp_replace(v, ",", "").try_cast("double")))


def numbered_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Rows of a headerless CSV as text with their place: ``_file``, ``_chunk`` (where the part of
    the file that one task reads begins) and ``_row``, which grows within a chunk.

    The functions of the running task give file and chunk: the planner pushes no filter below
    them, which would choose files, and with them other chunks, for one scan of two that meet."""
    raw = (spark.read.schema(", ".join(f"_c{i} string" for i in range(columns))).option("header", False)
           .option("escape", '"').csv(path))
    return raw.select("*", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_chunk"),
                      F.monotonically_increasing_id().alias("_row"))


_CHUNK = ["_file", "_chunk"]


def _before(c: str, n: Column) -> Column:
    """The sum of ``n`` over the chunks of a file before each one."""
    return (F.sum(n).over(Window.partitionBy("_file").orderBy("_chunk")) - n).alias(c)


def ordered_rows(rows: DataFrame, order: str = "_line") -> DataFrame:
    """The rows of ``numbered_csv`` with their line number in the file (0, 1, ...), from counts per
    chunk and numbers within it."""
    before = rows.groupBy(_CHUNK).agg(F.count("*").alias("_n")).select(*_CHUNK, _before("_lines", F.col("_n")))
    within = F.row_number().over(Window.partitionBy(_CHUNK).orderBy("_row")) - 1
    return (rows.withColumn("_within", within).join(before, _CHUNK)
            .select(*rows.columns, (F.col("_within") + F.col("_lines")).alias(order)))


def read_ordered_parts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headed CSV of several parts (``write_area_table``) as text, with ``line`` (from 1): the
    row's place over all parts, in the order of their numbers."""
    rows = ordered_rows(numbered_csv(spark, path, len(columns))).where("_line > 0")    # below each part's header
    part = F.regexp_extract("_file", r"part-([0-9]+)[^/]*$", 1).cast("bigint")
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(part)) - F.col("_n")          # a row for each part
    rows = rows.join(files.select("_file", before.alias("_before")), "_file")
    return rows.select((F.col("_before") + F.col("_line")).alias("line"),
                       *[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def read_formatted_sections(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S9 with stacked sections: a spreadsheet-saved result file holding several tables one
    under another (totals, then percentages, ...), separated by blank rows, each under its
    own header row.

    Returns the rows of every section with a ``section`` number (0, 1, ...) and ``columns``:
    the first as text (``NA``/empty -> NULL), the others as numbers. A section begins at a row
    that isn't blank after one that is. Such rows are numbered inside the chunks that tasks read
    (at most ``spark.sql.files.maxPartitionBytes``); one row for each chunk carries the count on
    to the next, so no task holds a whole file.
    """
    raw = numbered_csv(spark, path, len(columns))
    cols = raw.columns[:len(columns)]
    blank = F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.lit(False)) for c in cols], F.lit(True))
    df = raw.withColumn("_blank", blank)
    in_chunk = Window.partitionBy(_CHUNK).orderBy("_row")
    # a chunk's first row has no row before it here: what it is gets known with the chunks
    begins = ~F.col("_blank") & F.lag("_blank").over(in_chunk)
    df = df.withColumn("_begins", begins).withColumn("_inside", F.sum(F.coalesce(F.col("_begins").cast("int"), F.lit(0))).over(in_chunk))
    chunk = df.groupBy(_CHUNK).agg(F.min_by("_blank", "_row").alias("_first"), F.max_by("_blank", "_row").alias("_last"),
                                   F.max("_inside").alias("_n"))
    after_blank = F.coalesce(F.lag("_last").over(Window.partitionBy("_file").orderBy("_chunk")), F.lit(True))
    chunk = chunk.withColumn("_opens", ~F.col("_first") & after_blank)
    own = F.col("_n") + F.col("_opens").cast("int")
    chunk = chunk.select(*_CHUNK, "_opens", _before("_sections", own))
    df = df.join(chunk, _CHUNK)
    header = F.coalesce(F.col("_begins"), ~F.col("_blank") & F.col("_opens"))
    body = df.filter(~F.col("_blank") & ~header)
    out = [clean_text(F.col(cols[0])).alias(columns[0])]
    out += [_parse_formatted_number(clean_text(F.col(c))).alias(n) for c, n in zip(cols[1:], columns[1:])]
    section = F.col("_sections") + F.col("_opens").cast("int") + F.col("_inside") - 1
    return body.select(section.cast("int").alias("section"), *out)
