"""Folders of delimited text files whose headers may differ from file to file."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamiz.feeds import TEXT_ENCODING, TEXT_SEPARATOR
from tamiz.functions.text import file_name, path_name
from tamiz.session import materialize
from tamiz.sources.lines import AUTO, cut, decoded, file_facts, read_lines, records

TEXT_FILES = "*.[tT][xX][tT]"
MALFORMED = "fila con más campos que el encabezado"
EMPTY_FILE = "archivo sin encabezado"
UNKNOWN_FEED = "tipo de archivo no reconocido"

# Wanted columns that a row's file lacks.
ABSENT = "columnas_ausentes"

Paths = str | list[str]


def source_file() -> Column:
    return file_name(F.col("_metadata.file_name"))


def literal_path(path: str) -> str:
    """A path that stands for itself only: readers take ``[]{}*?`` for patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def glob_for(prefix: str = "") -> str:
    """File-name pattern of one feed, any case of the suffix."""
    return f"{prefix}{TEXT_FILES}"


def list_files(spark: SparkSession, paths: Paths, glob: str = TEXT_FILES) -> DataFrame:
    """Names and sizes of the matching files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    return files.select(
        source_file().alias("source_file"), "path", "length", "modificationTime"
    )


def file_names(spark: SparkSession, paths: Paths, glob: str = TEXT_FILES) -> DataFrame:
    """(path, archivo_origen) of every matching file, empty ones too, which a scan leaves out.

    The names come from the listing that Spark keeps on the driver for any scan.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    uris = spark.createDataFrame([(uri,) for uri in files.inputFiles()], "path string")
    # A listing writes file:///x where the rows of a scan have file:/x.
    path = F.regexp_replace("path", r"\A([^:/]+):///", "$1:/").alias("path")
    return uris.select(path, path_name(F.col("path")).alias("archivo_origen"))


def read_text(
    spark: SparkSession,
    paths: Paths,
    columns: list[str],
    glob: str = TEXT_FILES,
    sep: str = TEXT_SEPARATOR,
    encoding: str = TEXT_ENCODING,
    multiline: bool = False,
) -> DataFrame:
    """Files that all share one header, every column as text, plus ``archivo_origen``."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = _csv(spark, glob, sep, encoding, multiline).option("header", True).schema(schema)
    return rows.load(paths).select("*", source_file().alias("archivo_origen"))


def _csv(spark: SparkSession, glob: str, sep: str, encoding: str, multiline: bool):
    return (
        spark.read.format("csv")
        .option("pathGlobFilter", glob)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )


def named_otherwise(prefixes: tuple[str, ...]) -> Column:
    """Files whose name starts with none of ``prefixes``; the others are not read."""
    condition = F.lit(True)
    for p in prefixes:
        condition = condition & ~source_file().startswith(p)
    return condition


def read_headers(
    spark: SparkSession,
    paths: Paths,
    glob: str = TEXT_FILES,
    sep: str = TEXT_SEPARATOR,
    encoding: str = TEXT_ENCODING,
    outside: tuple[str, ...] = (),
) -> DataFrame:
    """(path, archivo_origen, header, encoding) of every file that has a header."""
    return _headers(file_facts(read_lines(spark, paths, glob, sep, named_otherwise(outside))), sep, encoding)


def _headers(facts: DataFrame, sep: str, encoding: str) -> DataFrame:
    text = decoded(F.col("header_value"), encoding, F.col("utf8"))
    cells = cut(F.regexp_replace(text, "\\A\ufeff", ""), sep)
    found = F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1") if encoding == AUTO else F.lit(encoding)
    return facts.select(
        "path",
        path_name(F.col("path")).alias("archivo_origen"),
        F.transform(cells, lambda c: F.coalesce(c, F.lit(""))).alias("header"),
        found.alias("encoding"),
    )


@dataclass
class TextScan:
    """Rows of the wanted columns, file headers, and notes on missing columns.

    A row with a filled cell beyond its file's header is marked ``malformed``.
    """

    rows: DataFrame
    headers: DataFrame
    warnings: DataFrame

    def shapes(self) -> DataFrame:
        """Rows and columns of every file."""
        counted = self.rows.groupBy("archivo_origen").agg(F.count(F.lit(1)).alias("filas"))
        widths = self.headers.select("archivo_origen", F.size("header").cast("bigint").alias("columnas"))
        filled = widths.join(counted, "archivo_origen", "left")
        return filled.fillna({"filas": 0}).select("archivo_origen", "filas", "columnas")


def scan_text(
    spark: SparkSession,
    paths: Paths,
    wanted: list[str] | None = None,
    glob: str = TEXT_FILES,
    sep: str = TEXT_SEPARATOR,
    encoding: str = TEXT_ENCODING,
    multiline: bool = False,
    outside: tuple[str, ...] = (),
    absent: bool = False,
    by_path: bool = False,
) -> TextScan:
    """Scan files with different headers; every file is read once.

    Lines are stored as they are read, and the files' headers and encodings come from
    what is stored. A line is cut into as many cells as it has, and its own file's
    header says which of them is which column, so column order, extra columns and
    widths do not matter. A wanted column the file lacks is null and noted in
    ``warnings``. Without ``wanted`` every column that any file has is read. Files named with
    a prefix in ``outside`` are left out. With ``absent`` every row has the wanted columns
    that its own file lacks. With ``by_path`` a file is known by its path, as namesakes
    in different folders are. ``encoding`` is that of all files; with ``auto`` each is UTF-8
    if all its bytes are valid, else Latin-1.

    A quoted cell may hold line breaks (``multiline`` is no longer needed for that): the
    files where one does are put together split by split. A quote that is never closed
    makes its row malformed, and what follows belongs to no row.
    """
    lines = read_lines(spark, paths, glob, sep, named_otherwise(outside))
    facts = file_facts(lines)
    headers = _headers(facts, sep, encoding)
    if by_path:
        headers = headers.withColumn("archivo_origen", F.col("path"))
    if wanted is None:
        wanted = header_columns(headers)
    lacking = F.array_except(F.array(*[F.lit(c) for c in wanted]), F.col("header"))
    extra = [F.col(ABSENT)] if absent else []
    positions = facts.join(headers.withColumn(ABSENT, lacking), "path").select(
        "path", "archivo_origen", "header_line", "open_quote", "utf8", *extra,
        F.size("header").alias("__size"),
        F.transform(F.array(*[F.lit(c) for c in wanted]), lambda c: F.array_position("header", c).cast("int")).alias("__at"),
    )
    positions = materialize(positions)
    plain = ["path", "line", "value", "nothing", "separated", F.lit(False).alias("unclosed")]
    if not facts.where("open_quote").isEmpty():
        broken = facts.where("open_quote").select("path")
        joined = records(lines.join(broken, "path", "left_semi"))
        whole = lines.join(broken, "path", "left_anti").select(*plain).unionByName(joined)
    else:
        whole = lines.select(*plain)
    # Blanks without a separator are no row; with one they are a row of nulls.
    rows = whole.where("NOT nothing OR separated").join(positions, "path").where("line != header_line")
    cells = F.when(~F.col("nothing"), cut(decoded(F.col("value"), encoding, F.col("utf8")), sep))
    rows = rows.withColumn("__cells", F.coalesce(cells, F.array().cast("array<string>")))
    over = F.slice("__cells", F.col("__size") + 1, F.greatest(F.size("__cells"), F.lit(1)))
    beyond = F.when(F.size("__cells") > F.col("__size"), F.concat_ws("", over) != "").otherwise(False)
    value = lambda i: F.get("__cells", F.get("__at", F.lit(i)) - 1)
    rows = rows.select(
        *[value(i).alias(c) for i, c in enumerate(wanted)],
        "archivo_origen",
        (beyond | F.col("unclosed")).alias("malformed"),
        *extra,
    )
    warnings = headers.where(F.size(lacking) > 0).select(
        F.col("archivo_origen").alias("source_file"),
        F.lit(None).cast("string").alias("sheet_name"),
        F.lit("columnas_faltantes").alias("code"),
        F.concat_ws(", ", lacking).alias("detail"),
    )
    return TextScan(rows, headers, warnings)


def header_columns(headers: DataFrame) -> list[str]:
    """Every column name once, those of the first file first."""
    named = headers.select("archivo_origen", F.posexplode("header"))
    first = named.groupBy("col").agg(F.min(F.struct("archivo_origen", "pos")).alias("place"))
    return [r["col"] for r in first.orderBy("place").collect()]
