"""Cell coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORD = "^([A-Z]+)([0-9]+)$"


def col_letters(n: Column) -> Column:
    """1-based column number as letters (bijective base 26, to XFD)."""
    m = n - 1
    one = F.chr(65 + m % 26)
    two = F.chr(65 + F.floor((m - 26) / 26) % 26)
    three = F.chr(65 + F.floor((m - 702) / 676) % 26)
    return F.when(n < 1, "").when(n <= 26, one).when(n <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def row_of(coord: Column) -> Column:
    """Row of a coordinate; null if it can't be parsed."""
    return F.nullif(F.regexp_extract(F.upper(coord), COORD, 2), F.lit("")).try_cast("int")


def col_of(coord: Column) -> Column:
    """Column number of a coordinate; null if it can't be parsed."""
    letters = F.regexp_extract(F.upper(coord), COORD, 1)
    n = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)
    return F.when(letters != "", n)


def coord_name(row: Column, col: Column) -> Column:
    return F.concat(col_letters(col), row.cast("string"))


def in_range(row: Column, col: Column, r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """Inside the rectangle, borders included; anything unparsable is outside."""
    return F.coalesce(row.between(r1, r2) & col.between(c1, c2), F.lit(False))


def range_name(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """``A1`` or ``A1:B2``; empty if there is no cell."""
    a, b = coord_name(r1, c1), coord_name(r2, c2)
    return F.when(r1.isNull() | c1.isNull(), "").when(a == b, a).otherwise(F.concat_ws(":", a, b))
