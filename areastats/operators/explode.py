"""List columns to rows.

``explode`` is a narrow ``Generate``: each company row becomes its site (or LA) rows inside
the task that read it, so no data moves. A NULL list yields no rows (``values_drop_na``),
empty elements between two commas are kept, as the reference keeps them. Cells of any length
are spread over tasks by ``explode_long_cells``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.lists import SEPARATOR, count_items, list_items
from .company import apportion_per_la, apportion_per_site


def explode_list(df: DataFrame, list_column: str, value_name: str) -> DataFrame:
    """One row per list element; the list column is replaced by ``value_name``."""
    cols = [c for c in df.columns if c != list_column]
    return df.select(*cols, F.explode(list_items(list_column)).alias(value_name))


#: Characters of a list cell that one piece holds, and that one row explodes at once.
PIECE_CHARS = 1 << 16


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def list_pieces(c: Column, piece: int, sep: str = SEPARATOR) -> Column:
    """A list cell in pieces of whole elements: an array of (base, text), where ``base`` is the
    position of a piece's first element in the list.

    A piece holds the elements that begin in its stretch of ``piece`` characters; the one that
    runs over the stretch's end is carried on to its own, so no element is cut. A stretch in
    which no element begins gives no piece.
    """
    n = F.greatest(F.ceil(F.length(c) / F.lit(float(piece))).cast("int"), F.lit(1))
    end = F.length(c) + F.lit(2)                      # where an element after the last would begin

    def begin(i: Column) -> Column:
        mark = F.call_function("locate", F.lit(sep), c, i * F.lit(piece))
        return F.when(i == 0, F.lit(1)).when((i == n) | (mark == 0), end).otherwise(mark + F.lit(1))

    def texts(begins: Column) -> Column:
        here, after = (lambda k: F.element_at(begins, k)), (lambda k: F.element_at(begins, k + F.lit(1)))
        cut = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(
            after(k) > here(k), F.substring(c, here(k), after(k) - here(k) - F.lit(1))))
        return F.filter(cut, lambda t: t.isNotNull())

    def placed(found: Column) -> Column:
        bases = F.aggregate(found, F.array(F.lit(0).cast("bigint")), lambda acc, t: F.concat(
            acc, F.array(F.element_at(acc, -1) + count_items(t, sep))))
        return F.zip_with(found, F.slice(bases, F.lit(1), F.size(found)), lambda t, b: F.struct(
            b.alias("base"), t.alias("text")))

    return _once(_once(F.transform(F.sequence(F.lit(0), n), begin), texts), placed)


def explode_long_cells(df: DataFrame, list_column: str, value_name: str, position: str | None = None,
                       piece: int = PIECE_CHARS) -> DataFrame:
    """``explode_list`` for lists of any length: a cell of over ``piece`` characters is cut into
    pieces of whole elements, which are dealt over tasks before they are exploded.

    ``position`` names a column for the element's place in its list (from 0), carried over the
    ends of the pieces. Shorter cells are exploded where they are read and don't move; the input
    is read once for each of the two.
    """
    cols = [c for c in df.columns if c != list_column]
    text, base, at = (_free(df, n) for n in ("_text", "_base", "_at"))
    long = F.length(list_column) > piece
    short = df.where(~long).select(*cols, F.lit(0).cast("bigint").alias(base), F.col(list_column).alias(text))
    cut = df.where(long).select(*cols, F.explode(list_pieces(F.col(list_column), piece)).alias(at))
    cut = cut.select(*cols, F.col(at)["base"].alias(base), F.col(at)["text"].alias(text))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # a given number: not merged again
    both = short.unionAll(cut.repartition(parts, F.xxhash64(text, base)))
    out = both.select(*cols, base, F.posexplode(list_items(text)).alias(at, value_name))
    if position is not None:
        out = out.withColumn(position, F.col(base) + F.col(at))
    return out.drop(base, at)


def _free(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def explode_sites(companies: DataFrame, long_cells: bool = False) -> DataFrame:
    """One row per company-site, carrying the per-site measures (P7). ``long_cells`` spreads
    lists of any length over tasks, at a second scan of the companies; rows are the same."""
    explode = explode_long_cells if long_cells else explode_list
    return explode(apportion_per_site(companies), S.POSTCODES, S.POSTCODE)


def explode_las(companies: DataFrame) -> DataFrame:
    """One row per company-LA, carrying the per-LA measures."""
    return explode_list(apportion_per_la(companies), S.LA_CODES, S.LACODE)


def max_list_width(companies: DataFrame) -> DataFrame:
    """The widest list of each kind (``max(No_sites, na.rm = TRUE)``), one row."""
    from .company import with_list_counts
    c = with_list_counts(companies)
    return c.agg(F.max(S.NO_SITES).alias("max_sites"), F.max(S.NO_LAS).alias("max_las"))


def unpivot_list(df: DataFrame, list_column: str, value_name: str) -> DataFrame:
    """U4: ``separate`` into positions and ``pivot_longer(values_drop_na = TRUE)`` in one step:
    a row per (position, value), at any list width, without a column per position."""
    cols = [c for c in df.columns if c != list_column]
    long = df.select(*cols, F.posexplode(list_items(list_column)).alias("_position", value_name))
    return long.filter(F.col(value_name).isNotNull()).drop("_position")


def unpivot_wide_list(wide: DataFrame, prefix: str, value_name: str) -> DataFrame:
    """``pivot_longer(starts_with(prefix), values_drop_na = TRUE)`` of a frame that is wide already."""
    values = [c for c in wide.columns if c.startswith(prefix)]
    ids = [c for c in wide.columns if c not in values]
    long = wide.unpivot(ids, values, "_position", value_name)
    return long.filter(F.col(value_name).isNotNull()).drop("_position")


def sites_by_position(companies: DataFrame) -> DataFrame:
    """U1 by way of U4: same rows as ``explode_sites``."""
    return unpivot_list(apportion_per_site(companies), S.POSTCODES, S.POSTCODE)
