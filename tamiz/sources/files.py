"""Whole files with their encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.sources.text import TEXT_FILES, source_file


def decode_content(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace the bytes by text and say which encoding they were in."""
    utf8 = F.is_valid_utf8(F.col(content).cast("string"))
    return df.withColumns(
        {
            "contenido": F.when(utf8, F.decode(content, "UTF-8")).otherwise(
                F.decode(content, "ISO-8859-1")
            ),
            "encoding": F.when(utf8, "utf-8").otherwise("ISO-8859-1"),
        }
    ).drop(content)


def read_files(spark: SparkSession, path: str, glob: str = TEXT_FILES) -> DataFrame:
    """(nombre_archivo, contenido, encoding), one row per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return decode_content(files.select(source_file().alias("nombre_archivo"), "content"))
