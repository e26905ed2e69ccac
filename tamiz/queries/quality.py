"""Reasons, splits, duplicates and file rules over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.operators import duplicates, quality
from tamiz.queries.registry import query, table
from tamiz.sinks.reports import sample_errors

CUSTOMER = """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segmento,
 CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS nombre,
 CAST(nullif(c_acctbal, 0) AS DECIMAL(12,2)) AS saldo FROM customer"""
SQL_REASONS = """concat_ws('; ', CASE WHEN segmento IS NULL THEN 'segmento faltante' END,
 CASE WHEN coalesce(nombre, '') = '' THEN 'nombre faltante' END,
 CASE WHEN saldo IS NULL THEN 'saldo faltante' END,
 CASE WHEN saldo <= 0 THEN 'saldo no positivo' END)"""


def checked_customers(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segmento"),
        F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_name")).alias("nombre"),
        F.nullif("c_acctbal", F.lit(0)).cast("decimal(12,2)").alias("saldo"),
    )
    rules = quality.missing_rules(["segmento"]) | {
        "nombre faltante": F.coalesce("nombre", F.lit("")) == "",
        "saldo faltante": F.col("saldo").isNull(),
        "saldo no positivo": F.coalesce(F.col("saldo") <= 0, F.lit(False)),
    }
    return quality.add_reasons(customers, rules)


@query(f"SELECT * FROM ({CUSTOMER}) WHERE {SQL_REASONS} = ''")
def quarantine_valid(spark, folder):
    return quality.valid_rows(checked_customers(spark, folder))


@query(f"SELECT *, {SQL_REASONS} AS reasons FROM ({CUSTOMER}) WHERE {SQL_REASONS} <> ''")
def quarantine_errors(spark, folder):
    return quality.error_rows(checked_customers(spark, folder)).withColumn("reasons", quality.reason_text())


@query(f"""SELECT c_custkey, {SQL_REASONS} AS reasons, segmento IS NULL OR saldo IS NULL AS falta
 FROM ({CUSTOMER})""")
def error_reasons(spark, folder):
    return checked_customers(spark, folder).select(
        "c_custkey",
        quality.reason_text().alias("reasons"),
        quality.any_missing(["segmento", "saldo"]).alias("falta"),
    )


@query(f"""WITH bad AS (SELECT * FROM ({CUSTOMER}) WHERE segmento IS NULL)
 SELECT c_custkey, nombre, CAST(NULL AS BIGINT) AS total FROM (SELECT * FROM bad ORDER BY c_custkey, nombre LIMIT 5)
 UNION ALL SELECT NULL, NULL, count(*) FROM bad""")
def error_sample(spark, folder):
    errors = quality.error_rows(checked_customers(spark, folder))
    sample, total = sample_errors(errors, "segmento faltante", ["c_custkey", "nombre"])
    return sample.unionByName(total, allowMissingColumns=True)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""")
def duplicate_rows(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return duplicates.duplicate_rows(lines, ["l_orderkey", "l_linenumber"])


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)
 SELECT l_orderkey, l_linenumber, l_partkey,
  (SELECT min(l_suppkey) FROM lineitem l WHERE l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.l_linenumber
    AND l.l_partkey = m.l_partkey) AS l_suppkey FROM m""")
def one_row_per_key(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("clave"), "l_partkey", "l_suppkey"
    )
    return duplicates.one_per_key(lines, "clave").select("clave.*", "l_partkey", "l_suppkey")


DOCUMENTS = "SELECT doc_id, concat(source, '_', lang) AS archivo_origen, sha256(text) AS id_registro FROM documents"
FAILED = f"""SELECT archivo_origen, 'ids duplicados' AS reason FROM (SELECT archivo_origen, id_registro FROM ({DOCUMENTS})
 GROUP BY archivo_origen, id_registro HAVING count(*) > 1) GROUP BY archivo_origen"""


def split_documents(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.concat_ws("_", "source", "lang").alias("archivo_origen"),
        F.sha2("text", 256).alias("id_registro"),
    )
    failed = quality.files_with_duplicates(rows, "id_registro", "ids duplicados")
    return quality.reject_files(rows, failed)


@query(f"""SELECT doc_id, archivo_origen, id_registro,
 archivo_origen IN (SELECT archivo_origen FROM ({FAILED})) AS rechazado FROM ({DOCUMENTS})""")
def reject_groups(spark, folder):
    split = split_documents(spark, folder)
    kept = split.kept.withColumn("rechazado", F.lit(False))
    return kept.unionByName(split.rejected.withColumn("rechazado", F.lit(True)))


@query(FAILED)
def reject_groups_failed(spark, folder):
    return split_documents(spark, folder).failed


@query("""SELECT DISTINCT source AS archivo_origen, 'texto vacío' AS reason FROM documents WHERE n_chars < 20
 UNION SELECT DISTINCT source, 'texto largo' FROM documents WHERE n_chars > 20000""")
def failing_files(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("source").alias("archivo_origen"), "n_chars")
    rules = {"texto vacío": F.col("n_chars") < 20, "texto largo": F.col("n_chars") > 20000}
    return quality.failing_files(docs, rules)
