"""Database tables through JDBC.

The connection comes from the session or the environment, never from code.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession

FIELDS = ("host", "port", "user", "password", "name")


def connection_options(spark: SparkSession) -> dict[str, str]:
    """``spark.tamiz.db.<field>``, else environment ``DB_<FIELD>``."""
    found = {
        f: spark.conf.get(f"spark.tamiz.db.{f}", None) or os.environ.get(f"DB_{f.upper()}")
        for f in FIELDS
    }
    absent = [f for f, v in found.items() if not v]
    if absent:
        raise ValueError(f"database settings missing: {', '.join(absent)}")
    return {
        "url": f"jdbc:postgresql://{found['host']}:{found['port']}/{found['name']}",
        "user": found["user"],
        "password": found["password"],
        "driver": "org.postgresql.Driver",
    }


def key_query(
    table: str,
    key: str = "id_registro",
    date: str | None = None,
    between: tuple[dt.date, dt.date] | None = None,
) -> str:
    """Only the key column, and only the dates of the batch, leave the database."""
    query = f"select {key} from {table}"
    if date and between:
        low, after = between[0], between[1] + dt.timedelta(days=1)
        query += f" where {date} >= date '{low:%Y-%m-%d}' and {date} < date '{after:%Y-%m-%d}'"
    return f"({query}) keys"


def month_predicates(date: str, first: dt.date, last: dt.date) -> list[str]:
    """One range predicate per month: the partitions of a parallel JDBC read."""
    found, low = [], first.replace(day=1)
    while low <= last:
        after = (low.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        found.append(f"{date} >= date '{low:%Y-%m-%d}' and {date} < date '{after:%Y-%m-%d}'")
        low = after
    return found


def read_keys(
    spark: SparkSession,
    options: dict[str, str],
    table: str,
    key: str = "id_registro",
    date: str | None = None,
    between: tuple[dt.date, dt.date] | None = None,
    fetch_rows: int = 10_000,
) -> DataFrame:
    """Ids of a target table; with a date range, one parallel query per month."""
    properties = {k: v for k, v in options.items() if k != "url"} | {"fetchsize": str(fetch_rows)}
    if date and between:
        keys = spark.read.jdbc(
            options["url"], table, predicates=month_predicates(date, *between), properties=properties
        )
        return keys.select(key)
    return spark.read.jdbc(options["url"], key_query(table, key), properties=properties)


def target_columns(spark: SparkSession, options: dict[str, str], table: str) -> list[str]:
    """Column names of a target; no rows are read."""
    reader = spark.read.format("jdbc").options(**options)
    return reader.option("query", f"select * from {table} where 1 = 0").load().columns
