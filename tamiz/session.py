"""Shared scratch space, stored intermediate tables, null-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()
_AREA: ContextVar[str | None] = ContextVar("area", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without that setting a local session gets its own temporary folder; on a
    cluster the setting is required, because a machine-local folder would be lost
    with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tamiz-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet.

    All paths of an application lie in one folder, to be removed when it has ended.
    """
    application = spark.sparkContext.applicationId
    area = _AREA.get()
    return f"{shared_folder(spark)}/tamiz-{application}/{f'{area}/' if area else ''}{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder and all it holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def _stored_in(area: str | None):
    token = _AREA.set(area)
    try:
        yield
    finally:
        _AREA.reset(token)


@contextmanager
def released(spark: SparkSession):
    """What is stored within this block is deleted at its end; tables that read it are of no use afterwards.

    ``with released(spark) as lasting``: what is stored within a further block ``with lasting():``
    stays, as if it were outside.
    """
    outer = _AREA.get()
    area = f"{outer}/area-{uuid.uuid4().hex}" if outer else f"area-{uuid.uuid4().hex}"
    try:
        with _stored_in(area):
            yield partial(_stored_in, outer)
    finally:
        discard(spark, f"{shared_folder(spark)}/tamiz-{spark.sparkContext.applicationId}/{area}")


#: For tables that hold an id in every row: hex digits take half of their bytes with it.
ZSTD = {"compression": "zstd"}


@contextmanager
def short_methods(spark: SparkSession):
    """What is run within this block is compiled to code in pieces, where one piece were too long for the JVM to compile."""
    name, bytes_compiled = "spark.sql.codegen.hugeMethodLimit", 8000
    before = spark.conf.get(name, None)
    spark.conf.set(name, bytes_compiled)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """What is run within this block hands rows to Python in batches of about ``size``, however long the rows are.

    Without it a batch has 10,000 rows, which for long texts are held many times over: by the JVM, outside of
    its heap, and by the worker, as Arrow and as objects.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def passing_shuffles(spark: SparkSession):
    """What is stored within this block deletes its shuffled files once it is stored, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Lineage ends at the written table, so a lost executor costs a re-read. Spark
    knows the size of the table: as a side of a join it is broadcast when it is
    within ``spark.sql.autoBroadcastJoinThreshold``, otherwise both sides shuffle
    and adaptive execution splits skewed partitions. ``options`` are those of the writer.
    """
    path = scratch(df.sparkSession, "stored")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_null_safe(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Join on ``keys`` where null equals null: left's columns and right's ``extra``."""
    equal = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in keys]
    joined = left.alias("l").join(right.alias("r"), reduce(lambda a, b: a & b, equal), how)
    return joined.select("l.*", *[F.col(f"r.`{c}`") for c in extra])


def ship(spark: SparkSession) -> None:
    """Send this package to the tasks of an application whose machines don't have it installed.

    Needed where Python runs in tasks (workbooks, corpus operators) and the package is
    on the driver's path only. A second call for the same application does nothing.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tamiz-")) / "tamiz.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)
