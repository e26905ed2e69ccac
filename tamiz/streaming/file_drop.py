"""Load files as they are dropped into a folder.

The stream only discovers files: it lists names and reads no content. Each
micro-batch then runs the batch plan over its whole files, so file-level rules hold.
A micro-batch that is run again after a failure finds the ids it wrote before, or
replaces its own folders, and so adds nothing twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tamiz.plans.folders import contacts_folder, messages_folder, payments_folder
from tamiz.plans.load import load_batch
from tamiz.session import released
from tamiz.sources.text import TEXT_FILES, literal_path
from tamiz.sources.workbook import WORKBOOKS

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
FILES_PER_BATCH = 10_000

# Target table -> names of its files, plan that cleans them.
FEEDS = {
    "gestiones": (WORKBOOKS, contacts_folder),
    "sms": (WORKBOOKS, messages_folder),
    "pagos": (TEXT_FILES, payments_folder),
}


def dropped_files(
    spark: SparkSession, folder: str, glob: str = TEXT_FILES, per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """A stream of the paths of new files."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_batch)
    )
    return files.load(folder).select("path", "modificationTime", "length")


def batch_name(files: list[tuple]) -> str:
    """The same for a micro-batch that is run again, different for any other files."""
    return hashlib.sha256(repr(files).encode()).hexdigest()[:32]


def load_dropped(
    spark: SparkSession,
    table: str,
    folder: str,
    target: str,
    checkpoint: str,
    reports: str | None = None,
    per_batch: int = FILES_PER_BATCH,
    on_load: Callable[[str, dict], None] | None = None,
    **options,
) -> StreamingQuery:
    """Load the files dropped since the last run, then stop.

    ``reports`` receives one error report per micro-batch, ``on_load`` the name and counts of
    each as soon as it is published; ``options`` go to the plan. What a micro-batch stored
    on its way is deleted at its end.
    """
    glob, clean = FEEDS[table]

    def load(files: DataFrame, _: int) -> None:
        # At most ``per_batch`` file entries.
        found = sorted(tuple(r) for r in files.collect())
        if found:
            name = batch_name(found)
            with released(files.sparkSession):
                result = clean(files.sparkSession, [literal_path(path) for path, *_ in found], **options)
                load = load_batch(result, table, target, name, f"{reports}/{name}" if reports else None)
            if on_load:
                on_load(name, load.metrics)

    return (
        dropped_files(spark, folder, glob, per_batch)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
