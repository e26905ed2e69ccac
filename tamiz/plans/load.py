"""Clean rows to a target: structure check, lookup, append, report, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tamiz import feeds
from tamiz.operators.duplicates import one_per_key
from tamiz.operators.incremental import ID, observed
from tamiz.operators.quality import REASONS, add_reasons, error_rows, missing_rules, too_long, valid_rows
from tamiz.operators.schema import check_target
from tamiz.plans.result import Result
from tamiz.sinks.reports import write_error_report
from tamiz.session import ZSTD, materialize, scratch
from tamiz.sinks.tables import BATCH, MONTH, append_batch, month_of, months_in, read_target

# The date that places a row in the target.
DATES = {"gestiones": "fecha_gestion", "sms": "fecha_sms", "pagos": "fecha_pago"}

# Derived for reports; no target has it.
REPORT_ONLY = ["fecha_gestion_sencilla"]


def storage_schema(columns: dict[str, str]) -> str:
    """A target's columns as a reader schema: text without length, no defaults."""
    plain = {c: "string" if t.startswith("varchar") else t.split(" ")[0] for c, t in columns.items()}
    return ", ".join(f"`{c}` {t}" for c, t in plain.items())


def fit_target(rows: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows the target takes, rows with a missing value or a text too long for it)."""
    present = [c for c in feeds.mandatory(columns) if c in rows.columns]
    sizes = {c: n for c, n in feeds.lengths(columns).items() if c in rows.columns}
    checked = add_reasons(rows, missing_rules(present) | too_long(sizes))
    return valid_rows(checked), error_rows(checked)


def with_target_reasons(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Checked rows whose ``reasons`` also say what the target does not take."""
    present = [c for c in feeds.mandatory(columns) if c in rows.columns]
    sizes = {c: n for c, n in feeds.lengths(columns).items() if c in rows.columns}
    added = add_reasons(rows.withColumnRenamed(REASONS, "_before"), missing_rules(present) | too_long(sizes))
    reasons = F.when(F.size("_before") > 0, F.col("_before")).otherwise(F.col(REASONS))
    return added.withColumn(REASONS, reasons).drop("_before")


@dataclass
class Load:
    """Counts of a load, the rows appended, and every row that was not."""

    metrics: dict[str, object]
    new: DataFrame
    errors: DataFrame


def load_batch(
    result: Result, table: str, path: str, batch: str, report: str | None = None, name: str | None = None
) -> Load:
    """Append the valid rows whose id the target does not hold yet.

    ``batch`` names the input. Running it again under its name replaces what it had
    appended, whatever the input holds now: its own rows are left out of the lookup, and
    the new ones take their place in one step. Another input needs another name.
    ``name`` is the table made at ``path`` by ``create_table``, if it is to show the rows.

    Every count is taken while rows are written anyway, and kept with the batch (``load_history``).
    """
    spark = result.rows.sparkSession
    columns, date = feeds.TARGETS[table], DATES[table]
    rows = result.staged().rows.drop(*REPORT_ONLY)
    check_target(valid_rows(rows), list(columns), exact=True)
    checked = with_target_reasons(rows, columns)
    fine = F.size(REASONS) == 0

    # The ids, by month, in one pass that counts what it sees.
    place = scratch(spark, "ids")
    last = F.max(F.when(fine, F.col(date))).alias("last")
    seen, watch = observed(checked, f"checked {place}", F.count_if(fine).alias("fine"), last)
    seen.where(fine).select(ID, month_of(date).alias(MONTH)).write.options(**ZSTD).partitionBy(MONTH).parquet(place)
    months = set(months_in(spark, place))
    counts = watch.get
    batch_rows = valid_rows(checked)

    known = 0
    if months:
        ids = spark.read.schema(f"{ID} string").parquet(place)
        target = read_target(spark, path, f"{ID} string", months, before_batch=batch, ids=ids)
        # The ids are stored: few are broadcast, and the target's ids are only scanned.
        held, watch = observed(target.select(ID).join(ids, ID, "left_semi").distinct(), f"known {place}")
        held = materialize(held, **ZSTD)
        known = watch.get["filas"]
        if known:
            batch_rows = batch_rows.join(held, ID, "left_anti")
    metrics = {
        "validos": counts["fine"],
        "con_error": counts["filas"] - counts["fine"],
        "existentes": known,
        "ultima_fecha": counts["last"],
    }
    new = one_per_key(batch_rows, ID).select(*columns)
    entry = append_batch(new, path, date, batch, name, metrics={k: v if isinstance(v, int) else str(v) for k, v in metrics.items()})
    errors = error_rows(checked)
    if report:
        write_error_report(errors, report)
    schema = storage_schema(columns)
    appended = read_target(spark, path, schema, batch=batch).drop(MONTH, BATCH)
    return Load(metrics | {"unicos": known + entry.rows, "nuevos": entry.rows}, appended, errors)
