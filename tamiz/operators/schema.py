"""Column contracts: gates, renames, projections and target checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


class MissingColumns(ValueError):
    """A strict input lacks required columns."""


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Strict gate: fail unless every required column is there."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise MissingColumns(f"faltan {', '.join(absent)}")
    return df


def keep_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Tolerant projection: the wanted columns that exist, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def add_missing(df: DataFrame, wanted: list[str], default: str | None = None) -> DataFrame:
    """Add every absent column as text, null unless a default is given."""
    absent = {c: F.lit(default).cast("string") for c in wanted if c not in df.columns}
    return df.withColumns(absent) if absent else df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename all columns at once, so that names may be swapped."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def fill_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.fillna(dict(defaults))


def with_lineage(df: DataFrame, file: Column | str, load_time: Column | None = None) -> DataFrame:
    """Add the source file name and the load time."""
    name = F.lit(file) if isinstance(file, str) else file
    return df.withColumns(
        {"archivo_origen": name, "fecha_carga": F.current_timestamp() if load_time is None else load_time}
    )


def target_differences(
    columns: list[str], target: list[str], exact: bool = False
) -> dict[str, list[str]]:
    """Columns the target does not have and, when ``exact``, those it misses."""
    unknown = [c for c in columns if c not in target]
    absent = [c for c in target if c not in columns] if exact else []
    return {"desconocida": unknown, "faltante": absent}


def check_target(df: DataFrame, target: list[str], exact: bool = False) -> DataFrame:
    """Stop before a load whose columns do not fit the target table."""
    found = target_differences(df.columns, target, exact)
    if any(found.values()):
        raise MissingColumns(f"estructura distinta: {found}")
    return df


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; a column one frame lacks is null there."""
    first, *others = frames
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
