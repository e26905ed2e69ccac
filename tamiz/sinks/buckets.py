"""The ids of a target as a bucketed table, for batches too large to be broadcast.

Ids lie in the bucket that their hash names, a partition for each published folder. A
join by id then moves the batch's ids only: each task reads one bucket of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.operators.incremental import ID
from tamiz.sinks.manifest import FOLDER, Manifest


def index_ids(
    spark: SparkSession, name: str, path: str, buckets: int, key: str = ID, location: str | None = None
) -> None:
    """Make the table ``name`` hold the ids of every folder that the target at ``path`` has published, and of no other.

    Only folders that are new are read, and those of replaced or compacted batches are
    dropped. Run it after a load; a run that breaks off is made up for by the next.
    ``buckets`` must be no less than ``spark.sql.shuffle.partitions``, or joins shuffle the
    target after all; it is fixed when the table is made. Without a ``location`` the table
    lies in the warehouse.
    """
    live = {e.folder: e for e in Manifest(spark, path).read() if e.rows}
    held = set()
    if spark.catalog.tableExists(name):
        held = {r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    if gone := sorted(held - set(live)):
        places = ", ".join(f"PARTITION (`{FOLDER}` = '{f}')" for f in gone)
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {places}")
    new = sorted(set(live) - held)
    if not new:
        return
    places = [f"{path}/{FOLDER}={f}" for f in new]
    rows = spark.read.schema(f"`{key}` string, {FOLDER} string").option("basePath", path).parquet(*places)
    # Dealt by bucket first, so that a bucket is one file of each folder.
    dealt = rows.select(key, FOLDER).repartition(buckets, key)
    writer = dealt.write.mode("append").partitionBy(FOLDER).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", location) if location else writer).saveAsTable(name)


def held_ids(spark: SparkSession, name: str, path: str, ids: DataFrame, key: str = ID, before_batch: str | None = None) -> DataFrame:
    """Those of ``ids`` (distinct) that the target holds, by the bucketed table of ``index_ids``.

    ``before_batch`` leaves out the folders that hold that batch alone.
    """
    folders = [e.folder for e in Manifest(spark, path).read() if e.rows and e.batches != [before_batch]]
    target = spark.table(name).where(F.col(FOLDER).isin(folders)).select(key)
    return ids.select(key).distinct().hint("merge").join(target, key, "left_semi")
