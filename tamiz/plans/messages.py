"""Sent messages: document fallback, strict dates, phone format, counted ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tamiz import feeds
from tamiz.functions.dates import epoch_text, parse_date_strict, parse_timestamp
from tamiz.functions.identity import preimage
from tamiz.functions.text import (
    READER_NULLS, WORKBOOK_NULLS, blank_to_null, clean_nulls, integral_text, is_phone, truncate,
)
from tamiz.operators.counter import HOT_ROWS, group_counter
from tamiz.operators.quality import add_reasons, missing_rules
from tamiz.operators.schema import keep_available, rename, require_columns, union_by_name
from tamiz.plans.result import FAILED_SCHEMA, Result, no_warnings

MANDATORY = ["documento", "telefono", "fecha_sms"]
PHONE_FORMAT = "telefono no válido"

OUTPUT = [
    "id_registro", "tipo_documento", "documento", "nombre_usuario", "fecha_sms",
    "resultado", "texto_sms", "base", "telefono", "numero_comparendo",
    "identificador_infraccion", "archivo_origen", "fecha_carga",
]


def derive(raw: DataFrame) -> DataFrame:
    tokens = list(dict.fromkeys(WORKBOOK_NULLS + READER_NULLS))
    named = rename(clean_nulls(raw, tokens, skip=("archivo_origen",)), feeds.MESSAGE_NAMES)
    codes = ["documento", "telefono", "numero_comparendo"]
    day = parse_date_strict(F.col("fecha_sms"))
    return (
        named.withColumns({c: integral_text(blank_to_null(F.col(c))) for c in codes})
        .withColumn("documento", F.coalesce(*codes))
        .withColumns(
            {
                # The id uses the document when there is no ticket; the stored
                # column does not.
                "infraccion_id": F.coalesce("numero_comparendo", "documento"),
                "identificador_infraccion": F.coalesce("numero_comparendo", F.lit("")),
                "momento": F.coalesce(
                    parse_timestamp(F.col("fecha_sms")), day.cast("timestamp_ntz")
                ),
                "fecha_sms": day,
            }
        )
    )


def identify(df: DataFrame, position: str | None, hot_rows: int) -> DataFrame:
    moment = F.coalesce(epoch_text(F.col("momento")), F.lit(feeds.EMPTY_DATE))
    base = preimage(
        F.col("documento"), F.col("telefono"), moment, F.col("infraccion_id"), F.col("base")
    )
    counted = group_counter(
        df.withColumn("base_id", base), ["base_id", "archivo_origen"], "contador", position, hot_rows
    )
    return counted.withColumn(
        "id_registro", F.sha2(F.concat_ws("_", "base_id", F.col("contador").cast("string")), 256)
    )


def clean_messages(
    raw: DataFrame,
    position: str | None = None,
    hot_rows: int = HOT_ROWS,
    warnings: DataFrame | None = None,
) -> Result:
    """Clean message rows that carry ``archivo_origen``; texts are cut to the target."""
    spark = raw.sparkSession
    derived = derive(require_columns(raw, [*feeds.MESSAGE_COLUMNS, "archivo_origen"]))
    sizes = feeds.lengths(feeds.MESSAGE_TARGET)
    fitted = identify(derived, position, hot_rows).withColumns(
        {c: truncate(F.col(c), n) for c, n in sizes.items()}
    )
    rules = missing_rules(MANDATORY) | {
        PHONE_FORMAT: F.col("telefono").isNotNull() & ~is_phone(F.col("telefono"))
    }
    rows = add_reasons(fitted.withColumn("fecha_carga", F.current_timestamp()), rules)
    return Result(
        rows=rows.select(*OUTPUT, "reasons"),
        rejected=keep_available(derived.where(F.lit(False)), OUTPUT),
        failed_files=spark.createDataFrame([], FAILED_SCHEMA),
        warnings=no_warnings(spark) if warnings is None else warnings,
    )


def consolidate_messages(*sheets: DataFrame) -> DataFrame:
    """All sheets of the raw export under the report's column names."""
    df = rename(union_by_name(*sheets), feeds.MESSAGE_EXPORT_NAMES)
    return df.withColumn("TIPO DOCUMENTO", F.upper("`TIPO DOCUMENTO`"))
