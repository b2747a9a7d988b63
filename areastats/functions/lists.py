"""Delimited lists held in one text column (``Postcodes``, ``Localauthoritycodes``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: list separator and the LA code width used by the length rule
SEPARATOR = ","
LA_CODE_WIDTH = 9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def list_items(c: Column | str, sep: str = SEPARATOR) -> Column:
    """The list as an array; empty elements are kept, a NULL list stays NULL."""
    return F.split(_col(c), sep, -1)


def count_items(c: Column | str, sep: str = SEPARATOR) -> Column:
    """Number of elements = separators + 1 (P2, P4); NULL for a NULL list.

    Counted without building the array: length minus the length with separators removed.
    """
    c = _col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit(""))) + 1).cast("bigint")


def count_by_length(c: Column | str, width: int = LA_CODE_WIDTH) -> Column:
    """``floor(nchar / width)`` (P3): the reference's LA count. Overcounts from 10 codes on
    because n codes joined by commas are 10n-1 characters long (trap T4)."""
    return F.floor(F.length(_col(c)) / F.lit(width)).cast("bigint")
