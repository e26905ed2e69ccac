"""Row-wise date parsing with explicit formats."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tamiz.functions.text import strip

# Tried in this order for every row.
FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "dd/MM/yyyy",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy/MM/dd",
)

MIDNIGHT = r" 00:00:00(\.0+)?\z"
YEAR_MONTH_DAY = r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"


def shape(fmt: str) -> str | None:
    """Pattern of the texts a digits-only format can fit; None for other formats."""
    if re.search("[^yMdHmsS]|MMM", re.sub(r"'T'|[^A-Za-z]", "", fmt)):
        return None

    def digits(run: re.Match) -> str:
        letter, n = run[0][0], len(run[0])
        if letter == "S":
            return f"[0-9]{{1,{n}}}"
        return f"[0-9]{{{n}}}" if n > 1 else "[0-9]+"

    pattern = fmt.replace(".", r"\.").replace("[", "(?:").replace("]", ")?")
    pattern = re.sub(r"([yMdHmsS])\1*", digits, pattern)
    return rf"\A{pattern.replace("'T'", 'T')}\z"


def parse_timestamp(col: Column, formats: Sequence[str] = FORMATS) -> Column:
    """The first format that fits, as a timestamp without time zone.

    A failed parse costs an exception, so only texts of a format's shape are tried.
    """
    text = strip(col)
    tries = []
    for fmt in formats:
        parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
        pattern = shape(fmt)
        tries.append(F.when(text.rlike(pattern), parsed) if pattern else parsed)
    return F.coalesce(*tries)


def parse_day(col: Column, formats: Sequence[str] = FORMATS) -> Column:
    return parse_timestamp(col, formats).cast("date")


def parse_date_strict(col: Column) -> Column:
    """Year-month-day only; a midnight timestamp counts as its day."""
    text = F.regexp_replace(strip(col), MIDNIGHT, "")
    return F.when(text.rlike(YEAR_MONTH_DAY), F.try_to_date(text, "y-M-d"))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def epoch_text(ts: Column) -> Column:
    """Seconds since 1970 as Python prints them: ``1704164645.0``, ``….12``.

    Built from the fields of the timestamp, so it does not depend on the session
    time zone.
    """
    minutes = F.unix_date(ts.cast("date")).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    micros = minutes * 60_000_000 + second
    size = F.abs(micros)
    part = size % 1_000_000
    digits = F.rtrim(F.lpad(part.cast("string"), 6, "0"), F.lit("0"))
    return F.concat(
        F.when(micros < 0, "-").otherwise(""),
        F.floor((size - part) / 1_000_000).cast("string"),
        F.when(part == 0, ".0").otherwise(F.concat(F.lit("."), digits)),
    )
