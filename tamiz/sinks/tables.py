"""Target tables kept as parquet, published one batch at a time.

Every load writes a folder ``entrega=<id>/periodo=<month>`` of its own; the manifest says
which folders count. A batch that is run again replaces its rows, also when it has
fewer months or none. Loads of the same target must not run at the same time: there is
no primary key, ids are kept unique by looking them up first.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.feeds import mandatory
from tamiz.operators.incremental import ID, observed
from tamiz.session import ZSTD
from tamiz.sinks.ids import may_hold, write_summary
from tamiz.sinks.manifest import FOLDER, Conflict, Entry, Manifest

MONTH, BATCH = "periodo", "lote"
#: Folders of fewer rows are put together by ``compact``, up to so many.
SMALL = 5_000_000


def create_table(
    spark: SparkSession, name: str, columns: dict[str, str], location: str | None = None
) -> None:
    """Create the target unless it exists.

    Spark does not enforce a primary key or NOT NULL on parquet tables: the load
    looks ids up first, and :func:`unfit_rows` finds missing values.
    """
    body = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({body}, `{BATCH}` string, `{FOLDER}` string, `{MONTH}` string) "
        f"USING parquet PARTITIONED BY (`{FOLDER}`, `{MONTH}`){place}"
    )


def table_columns(spark: SparkSession, name: str) -> list[str]:
    """Columns of a target table, without those that only place its rows."""
    return [c for c in spark.table(name).columns if c not in (MONTH, BATCH, FOLDER)]


def unfit_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with a null the target does not take."""
    absent = [F.col(c).isNull() for c in mandatory(columns) if c in df.columns]
    condition = F.lit(False)
    for a in absent:
        condition = condition | a
    return df.where(condition)


def month_of(date: str):
    return F.date_format(F.col(date), "yyyy-MM")


def _write(rows: DataFrame, path: str, batches: list[str], key: str) -> Entry:
    """Write rows that have ``MONTH`` and ``BATCH`` to a fresh folder, with the summary of their ids; not yet published.

    The rebalance hint lets adaptive execution cut a hot month into several files and
    join small ones. Rows and months are counted as they are written.
    """
    folder = uuid.uuid4().hex
    place = f"{path}/{FOLDER}={folder}"
    counted, watch = observed(_dealt(rows, key), f"written {folder}")
    counted.write.options(**ZSTD).mode("overwrite").partitionBy(MONTH).parquet(place)
    entry = Entry(folder, batches, months_in(rows.sparkSession, place), watch.get["filas"])
    if entry.rows and key in rows.columns:
        written = rows.sparkSession.read.schema(f"{key} string").parquet(place)
        write_summary(written, path, entry, key)
    return entry


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by month. Ids of lower-case hex digits, as hashes are, move as bytes: half as many."""
    if dict(rows.dtypes).get(key) != "string":
        return rows.hint("rebalance", MONTH)
    packed, text = F.unhex(key), F.lower(F.hex("_packed"))
    moved = rows.withColumn("_packed", packed).withColumn("_packed", F.when(text == F.col(key), F.col("_packed")))
    moved = moved.withColumn(key, F.when(F.col("_packed").isNull(), F.col(key))).hint("rebalance", MONTH)
    return moved.withColumn(key, F.coalesce(F.col(key), text)).select(*rows.columns)


def months_in(spark: SparkSession, place: str) -> list[str]:
    """The months for which there is a folder, as the writer named them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(place)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    return sorted(n.removeprefix(f"{MONTH}=") for n in names if n.startswith(f"{MONTH}="))


def append_batch(
    df: DataFrame,
    path: str,
    date: str,
    batch: str,
    name: str | None = None,
    key: str = ID,
    metrics: dict | None = None,
) -> Entry:
    """Write one batch and publish it; what the batch had before, however many months, goes.

    Until it is published no reader sees a row of it. ``name`` is the table made at ``path``
    by ``create_table``, if it is to show the rows.
    """
    spark = df.sparkSession
    manifest = Manifest(spark, path)
    placed = df.withColumns({BATCH: F.lit(batch), MONTH: month_of(date)})
    entry = _write(placed, path, [batch], key)
    entry = replace(entry, metrics={batch: (metrics or {}) | {"nuevos": entry.rows}})

    def change(live: list[Entry]) -> list[Entry]:
        kept = []
        for old in live:
            if batch not in old.batches:
                kept.append(old)
            elif len(old.batches) > 1:
                # Folders put together lose the batch: their other rows are written anew.
                others = [b for b in old.batches if b != batch]
                rows = _read(spark, path, _stored(spark, path, old), [old]).where(F.col(BATCH) != batch)
                anew = _write(rows.drop(FOLDER), path, others, key)
                kept.append(replace(anew, metrics={b: m for b, m in old.metrics.items() if b != batch}))
        return [*kept, entry]

    before = manifest.commit(change)
    if name:
        show(spark, name, path, before)
    return entry


def _stored(spark: SparkSession, path: str, entry: Entry) -> str:
    """The columns of a folder as they were written."""
    found = spark.read.parquet(f"{path}/{FOLDER}={entry.folder}").schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found if f.name not in (MONTH, FOLDER))


def show(spark: SparkSession, name: str, path: str, before: list[Entry]) -> None:
    """Make the table ``name`` show what is published, given what was before; only what changed is named."""
    live = {e.folder: e for e in Manifest(spark, path).read()}
    gone = [e for e in before if e.folder not in live]
    new = [e for e in live.values() if e.folder not in {b.folder for b in before}]

    def places(entries: list[Entry]) -> list[str]:
        return [f"PARTITION (`{FOLDER}` = '{e.folder}', `{MONTH}` = '{m}')" for e in entries for m in e.months]

    if added := places(new):
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(added)}")
    if dropped := places(gone):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {', '.join(dropped)}")


def _read(spark: SparkSession, path: str, columns: str, entries: list[Entry], months: set[str] | None = None) -> DataFrame:
    stored = f"{columns}, {MONTH} string, {FOLDER} string"
    wanted = [(e, m) for e in entries for m in e.months if months is None or m in months]
    if not wanted:
        return spark.createDataFrame([], stored)
    # Only these folders are listed.
    places = [f"{path}/{FOLDER}={e.folder}/{MONTH}={m}" for e, m in wanted]
    return spark.read.schema(stored).option("basePath", path).parquet(*places)


def read_target(
    spark: SparkSession,
    path: str,
    schema: str,
    months: set[str] | None = None,
    before_batch: str | None = None,
    batch: str | None = None,
    ids: DataFrame | None = None,
    key: str = ID,
) -> DataFrame:
    """Rows of a target, and their ``periodo`` and ``lote``.

    Equal ids hold equal dates, so for a lookup only the ``months`` of the batch are
    opened, those and no others between them, and with ``ids`` only the folders that may
    hold one of them. ``before_batch`` leaves that batch's rows out, for a repeated
    load; ``batch`` reads only them.
    """
    entries = Manifest(spark, path).read()
    if months is not None:
        entries = [e for e in entries if months & set(e.months)]
    if batch:
        entries = [e for e in entries if batch in e.batches]
    if before_batch:
        entries = [e for e in entries if e.batches != [before_batch]]
    if ids is not None:
        entries = may_hold(spark, path, entries, ids, key)
    rows = _read(spark, path, f"{schema}, {BATCH} string", entries, months)
    if before_batch and any(before_batch in e.batches for e in entries):
        rows = rows.where(F.col(BATCH) != before_batch)
    if batch:
        rows = rows.where(F.col(BATCH) == batch)
    return rows.select(*[c for c in rows.columns if c not in (MONTH, BATCH, FOLDER)], MONTH, BATCH)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """(lote, medida, valor): the counts that each load took as it wrote, for every batch that is there."""
    rows = [(b, k, str(v)) for e in Manifest(spark, path).read() for b, m in e.metrics.items() for k, v in m.items()]
    return spark.createDataFrame(rows, "lote string, medida string, valor string")


def compact(spark: SparkSession, path: str, schema: str, small: int = SMALL, name: str | None = None, key: str = ID) -> int:
    """Put folders of fewer than ``small`` rows together; returns how many were.

    They are taken in the order of their publishing, up to ``small`` rows a new folder.
    Loads may go on meanwhile: the change is published against the latest list, and if
    one of the folders was replaced in between, nothing changes and its new rows stay.
    """
    manifest = Manifest(spark, path)
    groups, size = [[]], 0
    for entry in manifest.read():
        if entry.rows >= small:
            continue
        if size + entry.rows > small and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(entry)
        size += entry.rows
    done = 0
    for group in groups:
        if len(group) < 2:
            continue
        rows = _read(spark, path, f"{schema}, {BATCH} string", group).drop(FOLDER)
        merged = _write(rows, path, sorted({b for e in group for b in e.batches}), key)
        merged = replace(merged, metrics={b: m for e in group for b, m in e.metrics.items()})
        names = {e.folder for e in group}

        def change(live: list[Entry]) -> list[Entry]:
            if not names <= {e.folder for e in live}:
                raise Conflict("a batch was loaded again while it was being put together")
            first = next(i for i, e in enumerate(live) if e.folder in names)
            return [*live[:first], merged, *[e for e in live[first:] if e.folder not in names]]

        try:
            before = manifest.commit(change)
        except Conflict:
            continue
        done += len(group)
        if name:
            show(spark, name, path, before)
    return done
