"""Lenient number parsing; money never passes through a double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tamiz.functions.text import strip

WIDE = "decimal(38,10)"


def to_decimal(col: Column, precision: int = 18, scale: int = 2) -> Column:
    """Text to decimal, null when it is not a finite number or does not fit."""
    return strip(col).try_cast(f"decimal({precision},{scale})")


def to_bigint(col: Column) -> Column:
    """Text to bigint, null when it is not a whole number."""
    number = strip(col).try_cast(WIDE)
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def truncated_sum(a: Column, b: Column, null_as_zero: bool = True) -> Column:
    """Sum of two text amounts, fraction cut toward zero, as integer text.

    With ``null_as_zero`` a part that is missing or no number counts as 0. A number
    too large for an amount never does: the sum is null then.
    """

    def part(c: Column) -> Column:
        amount = strip(c).try_cast("decimal(28,6)")
        if not null_as_zero:
            return amount
        size = F.abs(strip(c).try_cast("double"))
        large = F.coalesce((size >= 1e21) & (size < float("inf")), F.lit(False))
        return F.coalesce(amount, F.when(~large, F.lit(0).cast("decimal(28,6)")))

    return (part(a) + part(b)).try_cast("bigint").cast("string")
