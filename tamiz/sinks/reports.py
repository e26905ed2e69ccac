"""Error reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tamiz.operators.quality import REASONS, reason_text


def report_name(prefix: str, day: dt.date) -> str:
    return f"{prefix}_{day:%Y%m%d}"


def write_error_report(errors: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header; reasons as one text. One file per task.

    A report written again, as when a batch is run again, replaces the one before.
    """
    flat = errors.withColumn(REASONS, reason_text())
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def sample_errors(
    errors: DataFrame, reason: str, columns: list[str], n: int = 5
) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows that failed for ``reason``, and how many failed in all."""
    bad = errors.where(F.array_contains(REASONS, reason))
    return bad.select(*columns).orderBy(*columns).limit(n), bad.agg(F.count(F.lit(1)).alias("total"))
