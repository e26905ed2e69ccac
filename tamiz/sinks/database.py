"""Append to a database table through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS_PER_LOT = 500


def write_options(options: dict[str, str], lot: int = ROWS_PER_LOT) -> dict[str, str]:
    return options | {"batchsize": str(lot), "isolationLevel": "READ_COMMITTED"}


def append_rows(
    df: DataFrame,
    options: dict[str, str],
    table: str,
    connections: int = 16,
    lot: int = ROWS_PER_LOT,
) -> None:
    """Insert in lots over a bounded number of connections.

    Each partition commits by itself. A load that stops half-way is completed by
    running it again, because rows already there are found by their id.
    """
    writer = df.repartition(connections).write.format("jdbc").mode("append")
    writer.options(**write_options(options, lot)).option("dbtable", table).save()
