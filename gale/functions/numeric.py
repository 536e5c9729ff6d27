"""Numeric column helpers with numpy's rounding and null-safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    """numpy ``round(x, digits)``: scale, ``rint`` (ties to even), unscale.

    ``bround`` rounds the decimal representation and disagrees with numpy on
    values such as 0.575, so ``rint`` on the scaled double is used instead.
    """
    c = col_(c).cast("double")
    if digits == 0:
        return F.rint(c)
    if digits > 0:
        k = float(10 ** digits)
        return F.rint(c * F.lit(k)) / F.lit(k)
    k = float(10 ** (-digits))
    return F.rint(c / F.lit(k)) * F.lit(k)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den as double, null when den is 0 or either side is null."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (bigint, 0 for none)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
