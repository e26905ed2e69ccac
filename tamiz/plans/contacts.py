"""Contact attempts: defaults, fallbacks, dates, counted ids, file rule on dates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame, functions as F

from tamiz import feeds
from tamiz.functions.dates import FORMATS, day_text, epoch_text, parse_day, parse_timestamp
from tamiz.functions.identity import preimage
from tamiz.functions.numbers import WIDE
from tamiz.functions.text import READER_NULLS, WORKBOOK_NULLS, clean_nulls, first_filled, joined_code, strip
from tamiz.operators.counter import HOT_ROWS, group_counter
from tamiz.operators.quality import add_reasons, failing_files, missing_rules, reject_files
from tamiz.operators.schema import fill_defaults, keep_available, rename, require_columns
from tamiz.plans.result import FAILED_SCHEMA, Result, no_warnings

# Required by the cleaner or by the target table.
MANDATORY = ["documento", "telefono", "asesor", "fecha_gestion", "id_gestion", "resultado", "campana"]

OUTPUT = [
    "id_registro", "id_gestion_campaña", "tipo_documento", "documento",
    "nombre_usuario", "fecha_gestion", "tipo_llamada", "id_gestion", "resultado",
    "fecha_compromiso", "asesor", "campana", "telefono", "obligacion",
    "numero_comparendo", "valor", "identificador_infraccion", "archivo_origen",
    "fecha_carga", "fecha_gestion_sencilla",
]

BAD_DATE = "fecha_gestion no válida"


def derive(raw: DataFrame, formats: Sequence[str] = FORMATS) -> DataFrame:
    """Names, defaults, derived fields and types; one projection chain."""
    tokens = list(dict.fromkeys(WORKBOOK_NULLS + READER_NULLS))
    named = rename(clean_nulls(raw, tokens, skip=("archivo_origen",)), feeds.CONTACT_NAMES)
    amount = F.coalesce(strip(F.col("valor")).try_cast(WIDE), F.lit(0).cast(WIDE))
    return (
        fill_defaults(named, feeds.CONTACT_DEFAULTS)
        .withColumn("telefono", first_filled(F.col("telefono"), F.col("documento")))
        .withColumns(
            {
                "id_gestion": first_filled(
                    F.col("id_gestion"), joined_code(F.col("documento"), F.col("telefono"))
                ),
                "valor": amount.try_cast("decimal(12,2)"),
                "fecha_gestion": parse_timestamp(F.col("fecha_gestion"), formats),
                "fecha_compromiso": parse_day(F.col("fecha_compromiso"), formats),
                "identificador_infraccion": F.coalesce("obligacion", "numero_comparendo"),
            }
        )
        .withColumn("fecha_gestion_sencilla", day_text(F.col("fecha_gestion")))
    )


def identify(df: DataFrame, position: str | None, hot_rows: int) -> DataFrame:
    """Counted SHA-256 id.

    The counter runs over the joined fields themselves, so two rows of a file can
    never share an id and no duplicate check has to follow.
    """
    base = preimage(
        F.col("documento"), F.col("telefono"), F.col("asesor"),
        epoch_text(F.col("fecha_gestion")), F.col("id_gestion"),
        F.col("identificador_infraccion"), F.col("resultado"),
    )
    counted = group_counter(
        df.withColumn("base_id", base), ["base_id", "archivo_origen"], "contador", position, hot_rows
    )
    return counted.withColumn(
        "id_registro", F.sha2(F.concat_ws("_", "base_id", F.col("contador").cast("string")), 256)
    ).drop("base_id", "contador")


def clean_contacts(
    raw: DataFrame,
    on_bad_date: Literal["reject_file", "quarantine_row"] = "reject_file",
    position: str | None = None,
    hot_rows: int = HOT_ROWS,
    warnings: DataFrame | None = None,
    formats: Sequence[str] = FORMATS,
) -> Result:
    """Clean contact rows that carry ``archivo_origen``.

    ``position`` names a numeric row order within a file, if the source has one.
    """
    spark = raw.sparkSession
    derived = derive(require_columns(raw, [*feeds.CONTACT_COLUMNS, "archivo_origen"]), formats)
    split = None
    if on_bad_date == "reject_file":
        # Rejecting before the ids are built spares the shuffle of rejected rows.
        bad = failing_files(derived, {BAD_DATE: F.col("fecha_gestion").isNull()})
        split = reject_files(derived, bad)
        derived = split.kept
    rules = missing_rules(MANDATORY) | {"valor fuera de rango": F.col("valor").isNull()}
    rows = add_reasons(
        identify(derived, position, hot_rows).withColumn("fecha_carga", F.current_timestamp()),
        rules,
    ).select(*OUTPUT, "reasons")
    rejected = split.rejected if split else derived.where(F.lit(False))
    return Result(
        rows=rows,
        rejected=keep_available(rejected, OUTPUT),
        failed_files=split.failed if split else spark.createDataFrame([], FAILED_SCHEMA),
        warnings=no_warnings(spark) if warnings is None else warnings,
    )


