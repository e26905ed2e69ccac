"""Payments: agreement and ticket files to one table of identified payments."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz import feeds
from tamiz.functions.dates import FORMATS, parse_timestamp
from tamiz.functions.identity import record_id
from tamiz.functions.numbers import to_decimal, truncated_sum
from tamiz.functions.text import READER_NULLS, clean_nulls, first_filled, full_name
from tamiz.operators.date_order import ORDER, date_orders, order_warnings, parse_in_order
from tamiz.operators.duplicates import repeated_ids
from tamiz.operators.quality import add_reasons, failing_files, reject_files
from tamiz.operators.schema import add_missing, keep_available, union_by_name
from tamiz.plans.result import WARNING_SCHEMA, Result
from tamiz.session import ZSTD, materialize, short_methods
from tamiz.sources.text import ABSENT, MALFORMED

FILE = "archivo_origen"
DUPLICATE_IDS = "ids duplicados"

OUTPUT = [
    "id_registro", "nro_acuerdo", "nro_comparendo", "documento", "nombre_usuario",
    "valor", "fecha_pago", "archivo_origen", "identificador_infraccion", "fecha_carga",
]
CONSOLIDATED = [
    "nro_acuerdo", "nro_comparendo", "id_usuario", "nombre_usuario", "valor",
    "fecha_pago", "archivo_origen",
]


def _texts(raw: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns as clean text; a column the file lacks is null."""
    found = add_missing(keep_available(raw, [*wanted, "archivo_origen", "malformed", ABSENT]), wanted)
    if "malformed" not in found.columns:
        found = found.withColumn("malformed", F.lit(False))
    return clean_nulls(found, READER_NULLS, skip=("archivo_origen", ABSENT))


def _lacks(raw: DataFrame, *columns: str) -> Column:
    """Whether a row's input lacks one of the columns: the table, or the file it came from."""
    if not set(columns) <= set(raw.columns):
        return F.lit(True)
    if ABSENT not in raw.columns:
        return F.lit(False)
    return F.arrays_overlap(ABSENT, F.array(*map(F.lit, columns)))


def _name(raw: DataFrame) -> Column:
    """Without both columns there is no name."""
    named = full_name(F.col("nombres"), F.col("apellidos"))
    return F.when(_lacks(raw, "nombres", "apellidos"), "").otherwise(named).alias("nombre_usuario")


def _column_warnings(spark: SparkSession, inputs: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """A warning per input that lacks columns its feed usually has."""
    noted = []
    for raw, wanted in inputs:
        absent = [c for c in wanted if c not in raw.columns]
        if absent:
            noted.append((None, None, "columnas_faltantes", ", ".join(absent)))
    return spark.createDataFrame(noted, WARNING_SCHEMA)


def agreements(raw: DataFrame) -> DataFrame:
    df = _texts(raw, feeds.AGREEMENT_COLUMNS)
    return df.select(
        "nro_acuerdo",
        F.lit(None).cast("string").alias("nro_comparendo"),
        F.col("id_usuario").alias("documento"),
        _name(raw),
        "valor",
        "consecutivo_cuota",
        F.col("fecha_liquida").alias("fecha_pago"),
        F.col("nro_acuerdo").alias("identificador_infraccion"),
        "archivo_origen",
        "malformed",
    )


def tickets(raw: DataFrame, null_as_zero: bool = True) -> DataFrame:
    df = _texts(raw, feeds.TICKET_COLUMNS)
    number = first_filled(F.col("nro_comparendo"), F.col("nro_resolucion"))
    amount = truncated_sum(F.col("compute_0004"), F.col("intereses"), null_as_zero)
    amount = F.when(~_lacks(raw, "compute_0004", "intereses"), amount)
    return df.select(
        F.lit(None).cast("string").alias("nro_acuerdo"),
        number.alias("nro_comparendo"),
        F.col("id_usuario").alias("documento"),
        _name(raw),
        amount.alias("valor"),
        F.lit(None).cast("string").alias("consecutivo_cuota"),
        F.col("fecha_liquida_contrav").alias("fecha_pago"),
        number.alias("identificador_infraccion"),
        "archivo_origen",
        "malformed",
    )


def identify(df: DataFrame) -> DataFrame:
    """The id hashes the amount and date as received, before they are typed."""
    return df.withColumn(
        "id_registro",
        record_id(
            F.col("nro_acuerdo"), F.col("nro_comparendo"), F.col("documento"),
            F.col("nombre_usuario"), F.col("valor"), F.col("consecutivo_cuota"),
            F.col("fecha_pago"),
        ),
    )


def annotate(df: DataFrame, formats: Sequence[str] = FORMATS) -> DataFrame:
    """Types and reasons; ``formats`` are tried in order for the date, or the order of the row's file if it is known."""
    date = F.col("fecha_pago")
    parsed = parse_in_order(date, F.col(ORDER), formats) if ORDER in df.columns else parse_timestamp(date, formats)
    # Judged before it is rounded: 0.004 is more than nothing.
    exact = F.coalesce(to_decimal(F.col("valor"), 38, 10) <= 0, F.lit(False))
    typed = identify(df).withColumns(
        {
            "no_positivo": exact,
            "valor": to_decimal(F.col("valor"), 15, 2),
            "fecha_pago": parsed,
            "fecha_carga": F.current_timestamp(),
        }
    )
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "documento faltante": absent("documento"),
        "nombre_usuario faltante": absent("nombre_usuario"),
        "valor faltante": F.col("valor").isNull(),
        "valor no positivo": F.col("no_positivo"),
        "fecha_pago faltante": F.col("fecha_pago").isNull(),
        "identificador_infraccion faltante": F.col("identificador_infraccion").isNull(),
    }
    return add_reasons(typed, rules).select(*OUTPUT, "reasons", "malformed")


def clean_payments(
    agreement_rows: DataFrame | None = None,
    ticket_rows: DataFrame | None = None,
    on_duplicate: Literal["reject_file", "quarantine", "count"] = "reject_file",
    warnings: DataFrame | None = None,
    stage: bool = True,
    formats: Sequence[str] = FORMATS,
    dates: Literal["by_format", "by_file"] = "by_format",
) -> Result:
    """Clean both payment families; rows carry ``archivo_origen``.

    A malformed row makes its file fail. So do two valid rows of one file with the
    same id, unless ``on_duplicate`` quarantines just those rows or only warns about
    them. The checked rows are stored once, then the file rules and every use of the
    result read the columns they need; ``stage=False`` computes them each time. With
    ``dates`` by file, whether day or month comes first is learned from all dates of a
    file, and a file that leaves it open is warned of.
    """
    parts, inputs = [], []
    if agreement_rows is not None:
        parts.append(agreements(agreement_rows))
        inputs.append((agreement_rows, feeds.AGREEMENT_COLUMNS))
    if ticket_rows is not None:
        parts.append(tickets(ticket_rows))
        inputs.append((ticket_rows, feeds.TICKET_COLUMNS))
    both = union_by_name(*parts)
    if dates == "by_file":
        orders = materialize(date_orders(both, "fecha_pago", FILE))
        both = both.join(orders, FILE, "left")
        noted = order_warnings(orders, FILE)
        warnings = noted if warnings is None else warnings.unionByName(noted)
    rows = annotate(both, formats)
    if stage:
        with short_methods(rows.sparkSession):
            rows = materialize(rows, **ZSTD)
    missing_columns = _column_warnings(rows.sparkSession, inputs)
    warnings = missing_columns if warnings is None else missing_columns.unionByName(warnings)
    valid = rows.where(F.size("reasons") == 0)
    repeated = repeated_ids(valid, [FILE, "id_registro"])

    failed = failing_files(rows, {MALFORMED: F.col("malformed")})
    if on_duplicate == "reject_file":
        failed = failed.union(repeated.select(FILE, F.lit(DUPLICATE_IDS).alias("reason")).distinct())
    split = reject_files(rows.drop("malformed"), failed)
    kept = split.kept

    if on_duplicate == "count":
        noted = repeated.groupBy(F.col(FILE).alias("source_file")).agg(
            F.lit(None).cast("string").alias("sheet_name"),
            F.lit("ids_duplicados").alias("code"),
            F.sum("n").cast("string").alias("detail"),
        )
        warnings = warnings.unionByName(noted)
    if on_duplicate == "quarantine":
        side = materialize(repeated.select(FILE, "id_registro", F.lit(True).alias("again")))
        again = F.coalesce("again", F.lit(False)) & (F.size("reasons") == 0)
        reasons = F.when(again, F.array(F.lit(DUPLICATE_IDS))).otherwise(F.col("reasons"))
        kept = (
            kept.join(side, [FILE, "id_registro"], "left")
            .withColumn("reasons", reasons)
            .select(*OUTPUT, "reasons")
        )
    return Result(kept, split.rejected, split.failed, warnings, stored=stage)


def consolidate_payments(agreement_rows: DataFrame, ticket_rows: DataFrame) -> DataFrame:
    """Both families as text in one table, without ids or validation.

    Here a ticket amount with a missing part stays missing.
    """
    both = union_by_name(agreements(agreement_rows), tickets(ticket_rows, null_as_zero=False))
    return keep_available(both.withColumnRenamed("documento", "id_usuario"), CONSOLIDATED)
