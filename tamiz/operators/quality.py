"""Reasons, the valid / error split, and file-level rules."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tamiz.operators.duplicates import repeated_ids
from tamiz.session import materialize

REASONS = "reasons"


def missing(field: str) -> str:
    return f"{field} faltante"


def missing_rules(fields: list[str]) -> dict[str, Column]:
    return {missing(f): F.col(f).isNull() for f in fields}


def any_missing(fields: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f).isNull() for f in fields])


def add_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reasons``: the name of every rule whose condition is true."""
    return df.withColumn(REASONS, _broken(rules))


def _broken(rules: Mapping[str, Column]) -> Column:
    """Names of the broken rules; unlike ``array_compact`` this is compiled code."""
    found = F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()])
    return F.array_except(found, F.array(F.lit(None).cast("string")))


def reason_text(reasons: Column | str = REASONS) -> Column:
    return F.concat_ws("; ", reasons)


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where(F.size(REASONS) == 0).drop(REASONS)


def error_rows(df: DataFrame) -> DataFrame:
    return df.where(F.size(REASONS) > 0)


def too_long(lengths: Mapping[str, int]) -> dict[str, Column]:
    """Rules for text that does not fit its target column."""
    return {
        f"{c} excede {n}": F.coalesce(F.length(c) > n, F.lit(False)) for c, n in lengths.items()
    }


def failing_files(
    df: DataFrame, rules: Mapping[str, Column], file: str = "archivo_origen"
) -> DataFrame:
    """(file, reason) for every file with at least one row that breaks a rule.

    Grouping by file combines map-side to one row per task and file, so a file
    holding most of the rows costs no more than any other.
    """
    return df.select(F.col(file), F.explode(_broken(rules)).alias("reason")).distinct()


def files_with_duplicates(
    df: DataFrame, key: str, reason: str, file: str = "archivo_origen"
) -> DataFrame:
    repeated = repeated_ids(df, [file, key])
    return repeated.select(file, F.lit(reason).alias("reason")).distinct()


@dataclass
class FileSplit:
    """Rows of the accepted files, rows of the rejected ones, and why."""

    kept: DataFrame
    rejected: DataFrame
    failed: DataFrame


def reject_files(df: DataFrame, failed: DataFrame, file: str = "archivo_origen") -> FileSplit:
    """Take the files named in ``failed`` out of ``df``; one row per failed file remains.

    ``failed`` is evaluated once and stored; its stored size decides whether the
    names are broadcast or both sides shuffle.
    """
    reasons = F.concat_ws("; ", F.array_sort(F.collect_set("reason"))).alias("reason")
    failed = materialize(failed.groupBy(file).agg(reasons))
    names = failed.select(file)
    return FileSplit(
        kept=df.join(names, file, "left_anti"),
        rejected=df.join(names, file, "left_semi"),
        failed=failed,
    )
