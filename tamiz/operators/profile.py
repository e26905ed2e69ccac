"""Profiles and ordered samples of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of every non-null value, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column)
    return counted.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def _per_column(df: DataFrame, measures: dict[str, Column], names: list[str]) -> DataFrame:
    """One pass over ``df``, then one output row per column."""
    one_row = df.agg(*[m.alias(k) for k, m in measures.items()])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("columna"),
                *[F.col(f"{name}_{i}").alias(name) for name in names],
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return one_row.select(F.inline(rows))


def max_lengths(df: DataFrame) -> DataFrame:
    """Longest text of every column, 0 when it has no value."""
    longest = {
        f"longitud_{i}": F.coalesce(
            F.max(F.length(F.col(f"`{c}`").cast("string"))).cast("bigint"), F.lit(0).cast("bigint")
        )
        for i, c in enumerate(df.columns)
    }
    return _per_column(df, longest, ["longitud"])


def table_profile(df: DataFrame) -> DataFrame:
    """Rows and non-null values of every column, and its type."""
    counts = {}
    for i, c in enumerate(df.columns):
        counts[f"filas_{i}"] = F.count(F.lit(1))
        counts[f"no_nulos_{i}"] = F.count(F.col(f"`{c}`"))
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return _per_column(df, counts, ["filas", "no_nulos"]).withColumn("tipo", types[F.col("columna")])


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def row_slice(df: DataFrame, start: int, stop: int, *order: str) -> DataFrame:
    """Rows ``start`` to ``stop - 1`` of the ordered table."""
    return df.orderBy(*order).offset(start).limit(stop - start)
