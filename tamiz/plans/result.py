"""What a plan returns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.functions.text import path_name
from tamiz.operators.quality import error_rows, valid_rows
from tamiz.session import materialize

WARNING_SCHEMA = "source_file string, sheet_name string, code string, detail string"
FAILED_SCHEMA = "archivo_origen string, reason string"


def no_warnings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], WARNING_SCHEMA)


@dataclass
class Result:
    """Rows with their ``reasons``, rejected rows, failed files and warnings."""

    rows: DataFrame
    rejected: DataFrame
    failed_files: DataFrame
    warnings: DataFrame
    stored: bool = False
    #: The same with files told apart by path, where they are shown by name here.
    by_path: "Result | None" = None

    @property
    def valid(self) -> DataFrame:
        return valid_rows(self.rows)

    @property
    def errors(self) -> DataFrame:
        return error_rows(self.rows)

    def named(self) -> "Result":
        """Show files by name, once all rules that tell them apart by path are decided."""
        name = path_name(F.col("archivo_origen"))
        return replace(
            self,
            by_path=self,
            rows=self.rows.withColumn("archivo_origen", name),
            rejected=self.rejected.withColumn("archivo_origen", name),
            failed_files=self.failed_files.withColumn("archivo_origen", name),
            warnings=self.warnings.withColumn("source_file", path_name(F.col("source_file"))),
        )

    def staged(self) -> "Result":
        """Store the rows once, for a caller that reads ``valid`` and ``errors`` often.

        Scan, parse and hash then run once, and a lost executor costs a re-read
        instead of a re-run.
        """
        if self.stored:
            return self
        if self.by_path:
            return self.by_path.staged().named()
        return replace(self, rows=materialize(self.rows), stored=True)
