"""Rows that share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tamiz.session import join_null_safe, materialize, passing_shuffles


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each repeated key once, with ``n``; counted map-side before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same as :func:`duplicate_keys` for long keys such as text ids.

    Counting 64-bit hashes of the keys moves a fraction of their bytes. Only keys
    whose hash occurs twice, almost all of them truly repeated, are then counted
    themselves, so the answer is exact.
    """
    hashed = df.select(*keys, F.xxhash64(*keys).alias("__hash"))
    with passing_shuffles(df.sparkSession):
        suspects = materialize(duplicate_keys(hashed, ["__hash"]).select("__hash"))
    if suspects.isEmpty():
        fields = [*df.select(*keys).schema, T.StructField("n", T.LongType())]
        return df.sparkSession.createDataFrame([], T.StructType(fields))
    with passing_shuffles(df.sparkSession):
        return materialize(duplicate_keys(hashed.join(suspects, "__hash", "left_semi"), keys))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of every repeated key (nulls are equal).

    A semi join instead of a count window: a hot key is then split by the adaptive
    skew join, or not shuffled at all when the repeated keys are few.
    """
    repeated = materialize(duplicate_keys(df, keys).drop("n"))
    return join_null_safe(df, repeated, keys, "left_semi")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each key: the smallest, so that a repeated run gives the same.

    Only the keys are shuffled to find the repeated ones. Rows of other keys stay
    where they are; copies are combined map-side before they move.
    """
    repeated = repeated_ids(df, [key]).drop("n")
    if repeated.isEmpty():
        return df
    once = join_null_safe(df, repeated, [key], "left_anti")
    several = join_null_safe(df, repeated, [key], "left_semi")
    rest = [c for c in df.columns if c != key]
    smallest = several.groupBy(key).agg(F.min(F.struct(*rest)).alias("row"))
    return once.unionByName(smallest.select(key, "row.*"))
