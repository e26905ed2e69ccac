"""Deterministic SHA-256 row ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def preimage(*fields: Column, sep: str = "_") -> Column:
    """Fields joined by ``sep``; a null field is an empty one, never skipped."""
    return F.concat_ws(sep, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def record_id(*fields: Column, safe: bool = False) -> Column:
    """Hex SHA-256 of the joined fields.

    ``safe`` hashes a JSON object instead, where ``a_b`` + ``c`` and ``a`` + ``b_c``
    stay apart; the ids then differ from those of the plain form.
    """
    if safe:
        named = [f.cast("string").alias(f"f{i}") for i, f in enumerate(fields)]
        return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)
    return F.sha2(preimage(*fields), 256)
