"""Whole folders: text files of both payment families, and workbooks."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack, nullcontext
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz import feeds
from tamiz.functions.numbers import to_bigint
from tamiz.functions.text import path_name
from tamiz.operators.quality import REASONS, failing_files, reject_files
from tamiz.operators.schema import union_by_name
from tamiz.plans.contacts import clean_contacts
from tamiz.plans.messages import clean_messages
from tamiz.plans.payments import CONSOLIDATED, clean_payments, consolidate_payments
from tamiz.plans.result import Result
from tamiz.session import materialize, released
from tamiz.sources.text import EMPTY_FILE, MALFORMED, UNKNOWN_FEED, Paths, file_names, glob_for, scan_text
from tamiz.sources.workbook import read_workbooks, split_sheets


def unusable_files(names: DataFrame, headers: DataFrame) -> DataFrame:
    """Paths of ``names`` no header was read from: of unknown kind, or empty."""
    name = F.col("archivo_origen")
    known = name.startswith(feeds.AGREEMENT_PREFIX) | name.startswith(feeds.TICKET_PREFIX)
    reason = F.when(known, EMPTY_FILE).otherwise(UNKNOWN_FEED).alias("reason")
    unread = names.join(headers.select("path"), "path", "left_anti")
    return unread.select(F.col("path").alias("archivo_origen"), reason)


def payments_folder(
    spark: SparkSession,
    paths: Paths,
    multiline: bool = False,
    encoding: str = feeds.TEXT_ENCODING,
    once_read: Callable[[], None] | None = None,
    **options,
) -> Result:
    """Clean every payment file of a folder.

    Each family is one scan of its own files, and the checked rows are stored once; the
    lines they were made of are deleted then. A file that is malformed, unknown or has
    repeated ids is reported in ``failed_files``; the others go on. Files are told apart
    by path and shown by name. With the encoding ``auto`` each file is read in its own.
    ``once_read`` is called as soon as the files themselves are needed no more, with
    their rows yet to be checked.
    """
    with ExitStack() as block:
        # Rows that are not stored are made of the lines each time, so these stay.
        lasting = block.enter_context(released(spark)) if options.get("stage", True) else nullcontext
        scans = {
            prefix: scan_text(spark, paths, columns, glob_for(prefix), encoding=encoding, absent=True, by_path=True)
            for prefix, columns in (
                (feeds.AGREEMENT_PREFIX, feeds.AGREEMENT_COLUMNS),
                (feeds.TICKET_PREFIX, feeds.TICKET_COLUMNS),
            )
        }
        agreements, tickets = scans.values()
        names = file_names(spark, paths)
        if once_read:
            once_read()
        with lasting():
            result = clean_payments(
                agreements.rows,
                tickets.rows,
                warnings=materialize(agreements.warnings.unionByName(tickets.warnings)),
                **options,
            )
            headers = agreements.headers.unionByName(tickets.headers)
            unusable = unusable_files(names, headers)
            failed_files = materialize(result.failed_files.unionByName(unusable))
    return replace(result, failed_files=failed_files).named()


def whole_files(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that can be read as they are, and (file, reason) of those with cells beyond their header.

    ``archivo_origen`` is a path at first, so that namesakes stand for themselves, and the name in what is returned.
    """
    split = reject_files(rows, failing_files(rows, {MALFORMED: F.col("malformed")}))
    name = path_name(F.col("archivo_origen"))
    kept = split.kept.select(*rows.columns).drop("malformed").withColumn("archivo_origen", name)
    return kept, split.failed.withColumn("archivo_origen", name)


def concatenated_folder(
    spark: SparkSession,
    paths: Paths,
    whole_numbers: tuple[str, ...] = ("nro_acuerdo", "id_usuario"),
    encoding: str = feeds.TEXT_ENCODING,
) -> tuple[DataFrame, DataFrame]:
    """All rows and all columns of a folder's text files, whatever their headers, and the files that failed.

    ``whole_numbers`` become integers, null where a cell is none. A file with a cell
    beyond its header fails whole: (archivo_origen, reason).
    """
    rows, failed = whole_files(scan_text(spark, paths, encoding=encoding, by_path=True).rows)
    typed = {c: to_bigint(F.col(c)) for c in whole_numbers if c in rows.columns}
    return rows.withColumns(typed).withColumnRenamed("archivo_origen", "Fuente_Archivo"), failed


def consolidated_folder(
    spark: SparkSession, paths: Paths, encoding: str = feeds.TEXT_ENCODING
) -> tuple[DataFrame, DataFrame]:
    """Both payment families in one table of texts, and the files that failed; other files give what they have."""
    families = (feeds.AGREEMENT_PREFIX, feeds.TICKET_PREFIX)
    options = {"encoding": encoding, "by_path": True}
    scans = [
        scan_text(spark, paths, feeds.AGREEMENT_COLUMNS, glob_for(families[0]), **options),
        scan_text(spark, paths, feeds.TICKET_COLUMNS, glob_for(families[1]), **options),
        scan_text(spark, paths, CONSOLIDATED[:-1], outside=families, **options),
    ]
    (agreements, tickets, others), failed = zip(*[whole_files(scan.rows) for scan in scans])
    both = consolidate_payments(agreements, tickets)
    return both.unionByName(others.select(*CONSOLIDATED)), union_by_name(*failed)


def file_counts(result: Result) -> DataFrame:
    """Valid and error rows of every file, namesakes in two folders apart; one row per file leaves each task."""
    fine = F.size(REASONS) == 0
    counts = (result.by_path or result).rows.groupBy("archivo_origen").agg(
        F.count_if(fine).alias("validos"), F.count_if(~fine).alias("con_error")
    )
    return counts.withColumn("archivo_origen", path_name(F.col("archivo_origen")))


def files_without_valid_rows(result: Result) -> DataFrame:
    """Warnings for files whose rows are all errors."""
    return file_counts(result).where("validos = 0").select(
        F.col("archivo_origen").alias("source_file"),
        F.lit(None).cast("string").alias("sheet_name"),
        F.lit("sin_registros_validos").alias("code"),
        F.col("con_error").cast("string").alias("detail"),
    )


def _workbooks(spark: SparkSession, paths: Paths, columns: list[str], clean, **options) -> Result:
    # Workbooks are parsed once; every later pass reads the stored columns.
    sheets = materialize(read_workbooks(spark, paths, by_path=True))
    table, warnings, failed = split_sheets(sheets, columns)
    result = clean(table, position="posicion", warnings=warnings, **options)
    return replace(result, failed_files=result.failed_files.unionByName(failed)).named()


def contacts_folder(spark: SparkSession, paths: Paths, **options) -> Result:
    """Clean every contact workbook of a folder; rows keep their file order."""
    return _workbooks(spark, paths, feeds.CONTACT_COLUMNS, clean_contacts, **options)


def messages_folder(spark: SparkSession, paths: Paths, **options) -> Result:
    return _workbooks(spark, paths, feeds.MESSAGE_COLUMNS, clean_messages, **options)
