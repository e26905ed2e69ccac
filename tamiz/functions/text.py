"""Text normalisation (whole-cell null tokens, trimming, fallbacks, truncation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Cells that mean "no value" once a workbook is unified.
WORKBOOK_NULLS = ["", " ", "NULL", "nan", "NaN"]

# Cells the usual dataframe file readers already turn into nulls.
READER_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# The characters Python's str.strip() removes.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Fixed value: 7 to 15 ASCII digits and nothing else.
PHONE = r"\A[0-9]{7,15}\z"


def null_tokens(col: Column, tokens: list[str]) -> Column:
    """Null when the whole cell equals one of ``tokens``."""
    return F.when(~col.isin(tokens), col)


def clean_nulls(df: DataFrame, tokens: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Apply :func:`null_tokens` to every string column in one projection."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_tokens(F.col(f"`{c}`"), tokens) for c in texts if c not in skip})


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def full_name(first: Column, last: Column) -> Column:
    empty = F.lit("")
    return strip(F.concat(F.coalesce(first, empty), F.lit(" "), F.coalesce(last, empty)))


def joined_code(*cols: Column) -> Column:
    """Stripped parts joined by ``_``; null when any part is null."""
    parts = [strip(c) for c in cols]
    return reduce(lambda a, b: F.concat(a, F.lit("_"), b), parts)


def integral_text(col: Column) -> Column:
    """``3001234567.0`` -> ``3001234567``: number cells read through a float."""
    return F.regexp_replace(col, r"\A(-?[0-9]+)\.0\z", "$1")


def truncate(col: Column, length: int) -> Column:
    return F.substring(col, 1, length)


def is_phone(col: Column) -> Column:
    return F.coalesce(col.rlike(PHONE), F.lit(False))


def file_name(col: Column) -> Column:
    """Undo the percent-encoding of ``_metadata.file_name``; ``+`` stays a plus."""
    return F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


def path_name(col: Column) -> Column:
    """The file's name at the end of a path as ``_metadata.file_path`` gives it."""
    return file_name(F.substring_index(col, "/", -1))
