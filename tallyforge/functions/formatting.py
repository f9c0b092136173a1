"""Text forms of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Two decimals, thousands by commas."""
    return F.format_number(x, 2)


def percent_cell(x: Column) -> Column:
    """A signed percentage: one decimal, none from 1000 on; n/a without a value."""
    sign = F.when(x >= 0, "+").otherwise("-")
    plain = lambda d: F.replace(F.format_number(F.abs(x), d), F.lit(","), F.lit(""))
    return F.when(x.isNull(), "n/a").otherwise(F.concat(sign, F.when(F.abs(x) >= 1000, plain(0)).otherwise(plain(1)), F.lit("%")))


def human(x: Column) -> Column:
    """The largest of T, B, M and K that fits, with one decimal."""
    out = F.replace(F.format_number(x, 0), F.lit(","), F.lit(""))
    for unit, size in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
        out = F.when(F.abs(x) >= size, F.concat(F.format_number(x / size, 1), F.lit(unit))).otherwise(out)
    return out


def truncated(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last an ellipsis if some are left out."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 1)), F.lit("…"))).otherwise(text)
