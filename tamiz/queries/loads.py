"""Incremental loads, targets and reports over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tamiz import feeds
from tamiz.operators import incremental
from tamiz.plans.load import load_batch, storage_schema
from tamiz.plans.payments import clean_payments
from tamiz.queries import raw
from tamiz.queries.feeds import SQL_BOTH, SQL_PAYMENTS, comparable, payments
from tamiz.queries.registry import query, table
from tamiz.session import materialize, scratch
from tamiz.sinks.buckets import held_ids, index_ids
from tamiz.sinks.manifest import Manifest
from tamiz.sinks.reports import write_error_report
from tamiz.sinks.tables import append_batch, compact, create_table, load_history, month_of, read_target, table_columns

# The target holds the orders placed before this day; the batch brings all of them.
LOADED = "o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"
IDS = """SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS id_registro, o_orderkey, o_orderdate,
 o_totalprice > 0 AS valido FROM orders"""


def batch_and_target(spark, folder):
    orders = table(spark, folder, "orders").withColumn("id_registro", F.sha2(F.col("o_orderkey").cast("string"), 256))
    return orders, orders.where(LOADED).select("id_registro")


@query(f"SELECT id_registro, o_orderkey FROM ({IDS}) WHERE NOT ({LOADED})")
def incremental_new(spark, folder):
    batch, target = batch_and_target(spark, folder)
    return incremental.new_rows(batch, target).select("id_registro", "o_orderkey")


@query(f"SELECT DISTINCT id_registro FROM ({IDS}) WHERE {LOADED}")
def incremental_existing(spark, folder):
    return incremental.existing_ids(*batch_and_target(spark, folder))


@query(f"""SELECT count(*) AS validos, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS con_error,
 count(DISTINCT id_registro) AS unicos, count(*) FILTER ({LOADED}) AS existentes,
 strftime(max(o_orderdate), '%Y-%m-%d') AS ultima_fecha, count(*) FILTER (NOT ({LOADED})) AS nuevos FROM ({IDS})""")
def load_metrics(spark, folder):
    batch, target = batch_and_target(spark, folder)
    known = incremental.existing_ids(batch, target)
    found = incremental.load_metrics(batch, batch.where("o_orderstatus = 'F'"), known, "o_orderdate")
    return found.withColumn("ultima_fecha", F.date_format("ultima_fecha", "yyyy-MM-dd"))


def split_by_day(result):
    """The agreement rows as two inputs: an early one, and all of them."""
    early = result.rows.where("archivo_origen <= 'A_1997'")
    return early, result.rows


SQL_AGREEMENT_ROWS = SQL_BOTH.replace("FROM b)", "FROM b WHERE false)")


@query(SQL_AGREEMENT_ROWS + """SELECT count(*) FILTER (reasons = '') AS validos,
 count(*) FILTER (reasons <> '') AS con_error, count(DISTINCT id_registro) FILTER (reasons = '') AS unicos,
 count(*) FILTER (reasons = '' AND archivo_origen <= 'A_1997') AS existentes,
 max(fecha_pago) FILTER (reasons = '') AS ultima_fecha,
 count(*) FILTER (reasons = '' AND archivo_origen > 'A_1997') AS nuevos FROM checked""")
def incremental_load(spark, folder):
    """An early batch is loaded, then the whole feed; the counts of the second load."""
    target = scratch(spark, "target")
    whole = clean_payments(raw.raw_agreements(spark, folder))
    early, rows = split_by_day(whole)
    whole.rows = early
    load_batch(whole, "pagos", target, "early")
    whole.rows = rows
    metrics = load_batch(whole, "pagos", target, "whole").metrics
    last = metrics.pop("ultima_fecha").strftime("%Y-%m-%d %H:%M:%S")
    counts = [F.lit(v).cast("bigint").alias(k) for k, v in metrics.items()]
    return spark.range(1).select(*counts, F.lit(last).alias("ultima_fecha"))


@query(SQL_AGREEMENT_ROWS + "SELECT * EXCLUDE (reasons) FROM checked WHERE reasons = ''")
def incremental_load_target(spark, folder):
    """What the target holds after both loads and a repeated one."""
    target = scratch(spark, "target")
    whole = clean_payments(raw.raw_agreements(spark, folder))
    early, rows = split_by_day(whole)
    for batch, part in (("early", early), ("whole", rows), ("whole", rows)):
        whole.rows = part
        load_batch(whole, "pagos", target, batch)
    held = read_target(spark, target, storage_schema(feeds.PAYMENT_TARGET))
    return comparable(held.drop("periodo", "lote"), "fecha_pago")


VALID = "FROM checked WHERE reasons = ''"


@query(SQL_AGREEMENT_ROWS + f"SELECT * EXCLUDE (reasons) {VALID} AND archivo_origen BETWEEN 'A_1994' AND 'A_1995'")
def load_replaced(spark, folder):
    """Two batches are loaded, then run again: one with fewer months, one with none."""
    target = scratch(spark, "replaced")
    whole = clean_payments(raw.raw_agreements(spark, folder))
    rows, year = whole.rows, F.col("archivo_origen")
    for batch, part in (
        ("early", rows.where(year <= "A_1997")),
        ("late", rows.where(year > "A_1997")),
        ("early", rows.where(year.between("A_1994", "A_1995"))),
        ("late", rows.where("false")),
    ):
        whole.rows = part
        load_batch(whole, "pagos", target, batch)
    held = read_target(spark, target, storage_schema(feeds.PAYMENT_TARGET))
    return comparable(held.drop("periodo", "lote"), "fecha_pago")


@query(SQL_AGREEMENT_ROWS + f"""SELECT CAST(CAST(nro_acuerdo AS BIGINT) % 10 AS VARCHAR) AS lote, count(*) AS filas, sum(valor) AS total,
 2 AS carpetas {VALID} AND (CAST(nro_acuerdo AS BIGINT) % 10 <> 3 OR CAST(nro_acuerdo AS BIGINT) % 20 = 3) GROUP BY ALL""")
def target_compacted(spark, folder):
    """Ten batches are put together; one of them is then run again with half of its rows."""
    target, schema = scratch(spark, "compacted"), storage_schema(feeds.PAYMENT_TARGET)
    valid = materialize(clean_payments(raw.raw_agreements(spark, folder)).valid.select(*feeds.PAYMENT_TARGET))
    number = F.col("nro_acuerdo").cast("bigint")
    for n in range(10):
        append_batch(valid.where(number % 10 == n), target, "fecha_pago", str(n))
    compact(spark, target, schema)
    append_batch(valid.where(number % 20 == 3), target, "fecha_pago", "3")
    held = read_target(spark, target, schema)
    folders = len(Manifest(spark, target).read())
    return held.groupBy("lote").agg(
        F.count(F.lit(1)).alias("filas"), F.sum("valor").alias("total"), F.lit(folders).alias("carpetas")
    )


@query(SQL_AGREEMENT_ROWS + f""", batch AS (SELECT *, archivo_origen < 'A_1998' AS known {VALID}
  AND (archivo_origen >= 'A_1997' OR nro_acuerdo = (SELECT min(nro_acuerdo) {VALID} AND archivo_origen < 'A_1994')))
 SELECT count(*) FILTER (known) AS existentes, count(*) FILTER (NOT known) AS nuevos,
  count(DISTINCT fecha_pago[:7]) FILTER (known) AS meses FROM batch""")
def incremental_stray_date(spark, folder):
    """A batch of late payments and a single old one: of the months between none is opened."""
    target, schema = scratch(spark, "stray"), storage_schema(feeds.PAYMENT_TARGET)
    valid = materialize(clean_payments(raw.raw_agreements(spark, folder)).valid.select(*feeds.PAYMENT_TARGET))
    append_batch(valid.where("archivo_origen < 'A_1998'"), target, "fecha_pago", "old")
    old = valid.where("archivo_origen < 'A_1994'").agg(F.min("nro_acuerdo")).first()[0]
    batch = valid.where((F.col("archivo_origen") >= "A_1997") | (F.col("nro_acuerdo") == old))
    months = {r[0] for r in batch.select(month_of("fecha_pago")).distinct().collect()}
    held = read_target(spark, target, schema, months, ids=batch.select("id_registro"))
    opened = len({path.split("periodo=")[1][:7] for path in held.inputFiles()})
    found = incremental.increment(batch, held)
    counts = found.existing.agg(F.count(F.lit(1)).alias("existentes"), F.lit(0).cast("bigint").alias("nuevos")).unionByName(
        found.new.agg(F.lit(0).cast("bigint").alias("existentes"), F.count(F.lit(1)).alias("nuevos"))
    )
    return counts.agg(F.sum("existentes").alias("existentes"), F.sum("nuevos").alias("nuevos"), F.lit(opened).cast("bigint").alias("meses"))


@query(SQL_AGREEMENT_ROWS + f"SELECT DISTINCT id_registro {VALID} AND archivo_origen BETWEEN 'A_1994' AND 'A_1997'")
def incremental_bucketed(spark, folder):
    """A large batch against the target's ids in buckets, after one batch was replaced: the target isn't shuffled."""
    target, name, place = scratch(spark, "bucketed"), f"ids_{uuid.uuid4().hex}", scratch(spark, "ids")
    valid = materialize(clean_payments(raw.raw_agreements(spark, folder)).valid.select(*feeds.PAYMENT_TARGET))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    year = F.col("archivo_origen")
    for batch, rows in (("a", valid.where(year <= "A_1995")), ("b", valid.where(year.between("A_1996", "A_1997")))):
        append_batch(rows, target, "fecha_pago", batch)
        index_ids(spark, name, target, buckets, location=place)
    append_batch(valid.where(year.between("A_1994", "A_1995")), target, "fecha_pago", "a")
    index_ids(spark, name, target, buckets, location=place)
    return held_ids(spark, name, target, valid)


@query(SQL_AGREEMENT_ROWS + """, part(lote, tope) AS (VALUES ('early', 'A_1997'), ('whole', 'A_9999')),
 counted AS (SELECT lote, count(*) FILTER (reasons = '') AS validos, count(*) FILTER (reasons <> '') AS con_error,
  count(*) FILTER (reasons = '' AND lote = 'whole' AND archivo_origen <= 'A_1997') AS existentes,
  max(fecha_pago) FILTER (reasons = '') AS ultima_fecha,
  count(*) FILTER (reasons = '' AND (lote = 'early' OR archivo_origen > 'A_1997')) AS nuevos
  FROM checked JOIN part ON archivo_origen <= tope GROUP BY lote)
 UNPIVOT (SELECT lote, CAST(validos AS VARCHAR) AS validos, CAST(con_error AS VARCHAR) AS con_error,
  CAST(existentes AS VARCHAR) AS existentes, ultima_fecha, CAST(nuevos AS VARCHAR) AS nuevos FROM counted)
 ON validos, con_error, existentes, ultima_fecha, nuevos INTO NAME medida VALUE valor""")
def load_observed(spark, folder):
    """What two loads counted while they wrote, read from the target's history."""
    target = scratch(spark, "observed")
    whole = clean_payments(raw.raw_agreements(spark, folder))
    early, rows = split_by_day(whole)
    for batch, part in (("early", early), ("whole", rows)):
        whole.rows = part
        load_batch(whole, "pagos", target, batch)
    return load_history(spark, target)


@query(SQL_PAYMENTS)
def create_targets(spark, folder):
    """Every target table is created, payments are appended and read by name."""
    place = scratch(spark, "tables")
    suffix = place.rsplit("-", 1)[1]
    for name, columns in feeds.TARGETS.items():
        create_table(spark, f"{name}_{suffix}", columns, f"{place}/{name}")
    valid = payments(spark, folder).valid.select(*feeds.PAYMENT_TARGET)
    append_batch(valid, f"{place}/pagos", "fecha_pago", "1")
    spark.catalog.recoverPartitions(f"pagos_{suffix}")
    shown = spark.table(f"pagos_{suffix}").select(*table_columns(spark, f"pagos_{suffix}"))
    return comparable(shown, "fecha_pago")


@query(SQL_BOTH + """SELECT id_registro, nro_acuerdo, nro_comparendo, documento, nullif(nombre_usuario, '') AS nombre_usuario,
 CAST(valor AS VARCHAR) AS valor, archivo_origen, identificador_infraccion, reasons FROM checked
 WHERE reasons <> '' AND archivo_origen NOT IN (FROM failed)""")
def error_report_csv(spark, folder):
    path = scratch(spark, "report")
    write_error_report(payments(spark, folder).errors, path)
    return spark.read.option("header", True).option("escape", '"').csv(path).drop("fecha_pago", "fecha_carga")
