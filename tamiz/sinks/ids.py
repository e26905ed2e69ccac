"""Which folders of a target may hold an id: bitmaps over the ids' hashes.

A folder of n ids has a bitmap of 32 n to 64 n bits, a power of two, in pages of 32,768; an
id sets the bit that its hash names. A batch is compared page by page: a folder whose
bits have none in common with the batch's holds none of its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.sinks.manifest import FOLDER, IDS, Entry

PAGE = 1 << 15
BITS_AN_ID = 32
SCHEMA = f"bits int, page bigint, bitmap binary, {FOLDER} string"


def bits_for(rows: int) -> int:
    """A bitmap for so many ids has two to this power bits."""
    return max(15, (BITS_AN_ID * max(1, rows) - 1).bit_length())


def pages(ids: DataFrame, bits: int, key: str) -> DataFrame:
    """``page`` and ``bitmap`` of all ids; one row a page leaves each task."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    placed = ids.select(F.floor(slot / PAGE).alias("page"), (slot % PAGE).alias("place"))
    return placed.groupBy("page").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def write_summary(ids: DataFrame, path: str, entry: Entry, key: str) -> None:
    bits = bits_for(entry.rows)
    summary = pages(ids, bits, key).withColumn("bits", F.lit(bits))
    summary.select("bits", "page", "bitmap").write.mode("overwrite").parquet(f"{path}/{IDS}/{FOLDER}={entry.folder}")


def may_hold(spark: SparkSession, path: str, entries: list[Entry], batch: DataFrame, key: str) -> list[Entry]:
    """Those of ``entries`` that may hold an id of ``batch``; an entry without rows never does.

    All bitmaps of the same length are compared with one of the batch, whatever their
    number: a pair of pages for every page that is stored.
    """
    entries = [e for e in entries if e.rows]
    if not entries:
        return []
    base = f"{path}/{IDS}"
    places = [f"{base}/{FOLDER}={e.folder}" for e in entries]
    stored = spark.read.schema(SCHEMA).option("basePath", base).parquet(*places)
    sought = None
    for bits in sorted({bits_for(e.rows) for e in entries}):
        some = pages(batch, bits, key).select(F.lit(bits).alias("bits"), "page", F.col("bitmap").alias("sought"))
        sought = some if sought is None else sought.unionByName(some)
    both = stored.join(sought, ["bits", "page"]).select(FOLDER, "page", F.explode(F.array("bitmap", "sought")).alias("bitmap"))
    common = both.groupBy(FOLDER, "page").agg(F.bitmap_and_agg("bitmap").alias("common"))
    found = common.where(F.bitmap_count("common") > 0).select(FOLDER).distinct().collect()
    names = {r[0] for r in found}
    return [e for e in entries if e.folder in names]
