"""Which rows of a batch the target already holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from tamiz.operators.duplicates import one_per_key
from tamiz.operators.schema import union_by_name
from tamiz.session import materialize

ID = "id_registro"


def existing_ids(batch: DataFrame, target: DataFrame, key: str = ID) -> DataFrame:
    """The distinct batch ids that the target holds.

    The batch ids are stored first: while they are few they are broadcast, so the
    target's id column is only scanned. More of them are joined by shuffling both id
    columns; the ids are hashes, so that shuffle is even.
    """
    ids = materialize(batch.select(key).distinct())
    return target.select(key).join(ids, key, "left_semi").distinct()


def new_rows(batch: DataFrame, target: DataFrame, key: str = ID) -> DataFrame:
    """Batch rows whose id the target does not hold."""
    return batch.join(materialize(existing_ids(batch, target, key)), key, "left_anti")


@dataclass
class Increment:
    existing: DataFrame
    new: DataFrame


def increment(batch: DataFrame, target: DataFrame, key: str = ID) -> Increment:
    """The ids already loaded, and one row per id to append.

    Known rows leave before whole rows are shuffled to find repeated ids.
    """
    known = materialize(existing_ids(batch, target, key))
    return Increment(known, one_per_key(batch.join(known, key, "left_anti"), key))


def load_metrics(
    valid: DataFrame, errors: DataFrame, existing: DataFrame, date: str, key: str = ID
) -> DataFrame:
    """One row: valid, errors, unique, existing and new counts, and the last date."""
    rows = valid.agg(
        F.count(F.lit(1)).alias("validos"),
        F.count_distinct(key).alias("unicos"),
        F.max(date).alias("ultima_fecha"),
    )
    failed = errors.agg(F.count(F.lit(1)).alias("con_error"))
    known = existing.agg(F.count(F.lit(1)).alias("existentes"))
    names = ["validos", "con_error", "unicos", "existentes", "ultima_fecha"]
    # Three one-row aggregates laid side by side.
    row = union_by_name(rows, failed, known).agg(*[F.max(c).alias(c) for c in names])
    return row.withColumn("nuevos", F.col("unicos") - F.col("existentes"))


def observed(df: DataFrame, name: str, *metrics) -> tuple[DataFrame, Observation]:
    """Count rows (and ``metrics``) while the data passes, without an extra job.

    Put where no shuffle follows in the same job: a stage that is run again after a
    lost executor counts again, but a task that writes a result counts once.
    """
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("filas"), *metrics), watch
