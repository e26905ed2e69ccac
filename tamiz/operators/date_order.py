"""Day or month first, learned for each file from all of its dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tamiz.functions.dates import FORMATS, parse_timestamp
from tamiz.functions.text import strip

ORDER = "orden_fecha"
DAY_FIRST, MONTH_FIRST, UNDECIDED, MIXED = "día primero", "mes primero", "indeciso", "mezclado"

# Two short numbers, then a year, then perhaps a time of day.
NUMBERS = r"\A([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]([0-9]{4})((?:[ T].*)?)\z"


def _number(col: Column, place: int) -> Column:
    return F.regexp_extract(strip(col), NUMBERS, place).try_cast("int")


def date_orders(rows: DataFrame, date: str, file: str = "archivo_origen") -> DataFrame:
    """(file, ``ORDER``) for every file, by the dates that can be read in one way only.

    A number above 12 can be no month. One row per file leaves each task. A file whose
    dates all fit both ways is undecided; one with dates of both kinds is mixed.
    """
    first, second = _number(F.col(date), 1), _number(F.col(date), 2)
    votes = rows.groupBy(file).agg(
        F.count_if((first > 12) & (second <= 12)).alias("day"),
        F.count_if((second > 12) & (first <= 12)).alias("month"),
    )
    day, month = F.col("day") > 0, F.col("month") > 0
    order = F.when(day & month, MIXED).when(day, DAY_FIRST).when(month, MONTH_FIRST).otherwise(UNDECIDED)
    return votes.select(file, order.alias(ORDER))


def parse_in_order(date: Column, order: Column, formats: Sequence[str] = FORMATS) -> Column:
    """A date read as its file's are: month first only where that is known; other shapes by ``formats``."""
    parts = [F.regexp_extract(strip(date), NUMBERS, i) for i in (1, 2, 3, 4)]
    month_first = F.coalesce(order == MONTH_FIRST, F.lit(False))
    day = F.lpad(F.when(month_first, parts[1]).otherwise(parts[0]), 2, "0")
    month = F.lpad(F.when(month_first, parts[0]).otherwise(parts[1]), 2, "0")
    plain = F.concat(F.concat_ws("-", parts[2], month, day), F.regexp_replace(parts[3], "T", " "))
    return F.when(strip(date).rlike(NUMBERS), parse_timestamp(plain)).otherwise(parse_timestamp(date, formats))


def order_warnings(orders: DataFrame, file: str = "archivo_origen") -> DataFrame:
    """A warning for each file whose order can't be told; its dates are read day first."""
    return orders.where(F.col(ORDER).isin(UNDECIDED, MIXED)).select(
        F.col(file).alias("source_file"),
        F.lit(None).cast("string").alias("sheet_name"),
        F.lit("orden_de_fecha").alias("code"),
        F.col(ORDER).alias("detail"),
    )
