"""Schema operators, unions, profiles and ordered samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.operators import profile, schema
from tamiz.plans.messages import consolidate_messages as consolidate
from tamiz.queries.columns import CLEAN, untidy_events
from tamiz.queries.registry import query, table
from tamiz.sources.text import source_file


@query("""SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone, CAST('' AS VARCHAR) AS c_mail FROM customer""")
def tolerant_projection(spark, folder):
    df = schema.keep_available(table(spark, folder, "customer"), ["c_custkey", "c_phone", "c_name"])
    return schema.add_missing(schema.add_missing(df, ["c_phone"]), ["c_mail"], default="")


@query("SELECT c_mktsegment AS c_name, c_name AS base, c_custkey FROM customer")
def rename_map(spark, folder):
    df = table(spark, folder, "customer").drop("c_nationkey", "c_acctbal")
    return schema.rename(df, {"c_mktsegment": "c_name", "c_name": "base"})


@query("""SELECT s_suppkey, 'supplier.parquet' AS archivo_origen, '2025-01-02 00:00:00' AS fecha_carga FROM supplier""")
def lineage_columns(spark, folder):
    df = schema.with_lineage(
        table(spark, folder, "supplier"), source_file(), F.lit("2025-01-02 00:00:00")
    )
    return df.select("s_suppkey", "archivo_origen", "fecha_carga")


@query("""SELECT 'o_orderkey' AS columna, 'conocida' AS estado, count(o_orderkey) AS valores FROM orders
 UNION ALL SELECT 'o_custkey', 'conocida', count(o_custkey) FROM orders
 UNION ALL SELECT 'o_orderstatus', 'desconocida', count(o_orderstatus) FROM orders
 UNION ALL SELECT 'o_totalprice', 'conocida', count(o_totalprice) FROM orders
 UNION ALL SELECT 'o_orderdate', 'conocida', count(o_orderdate) FROM orders
 UNION ALL SELECT 'o_orderpriority', 'desconocida', count(o_orderpriority) FROM orders
 UNION ALL SELECT 'o_clerk', 'faltante', 0""")
def target_schema_check(spark, folder):
    """How the columns of a table fit a target, and how many values each would load."""
    orders = table(spark, folder, "orders")
    target = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_clerk"]
    found = schema.target_differences(orders.columns, target, exact=True)
    state = {c: s for s, names in found.items() for c in names}
    complete = schema.add_missing(orders, found["faltante"])
    label = F.create_map(*[F.lit(x) for c in complete.columns for x in (c, state.get(c, "conocida"))])
    return profile.table_profile(complete).select(
        "columna", label[F.col("columna")].alias("estado"), F.col("no_nulos").alias("valores")
    )


@query("""SELECT c_custkey, c_name, c_nationkey AS nacion, NULL AS s_suppkey FROM customer
 UNION ALL BY NAME SELECT s_suppkey, s_nationkey AS nacion FROM supplier""")
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.col("c_nationkey").alias("nacion")
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nacion"))
    return schema.union_by_name(customers, suppliers)


@query(f"SELECT limpio, count(*) AS n FROM (SELECT {CLEAN} AS limpio FROM events) WHERE limpio IS NOT NULL GROUP BY limpio")
def value_counts(spark, folder):
    return profile.value_counts(untidy_events(spark, folder), "limpio")


DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS columna, CAST(max(length(CAST({c} AS VARCHAR))) AS BIGINT) AS longitud FROM documents"
    for c in DOCUMENT_COLUMNS))
def max_length_profile(spark, folder):
    return profile.max_lengths(table(spark, folder, "documents").select(*DOCUMENT_COLUMNS))


PROFILED = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "limpio": "string"}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) AS filas, count({c}) AS no_nulos, '{t}' AS tipo "
    f"FROM (SELECT *, {CLEAN} AS limpio FROM events)"
    for c, t in PROFILED.items()))
def null_profile(spark, folder):
    return profile.table_profile(untidy_events(spark, folder).select(*PROFILED))


@query("""SELECT * FROM (SELECT 'primeras' AS parte, o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'últimas', o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def head_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    first, last = profile.head(orders, 5, "o_orderkey"), profile.tail(orders, 5, "o_orderkey")
    labelled = [df.select(F.lit(n).alias("parte"), "*") for n, df in (("primeras", first), ("últimas", last))]
    return schema.union_by_name(*labelled)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 173")
def row_slice(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return profile.row_slice(orders, 173, 180, "o_orderkey")


@query("""SELECT upper(role) AS "TIPO DOCUMENTO", CAST(conv_id AS VARCHAR) AS "DOCUMENTO", role AS "NOMBRE",
  text AS "TEXTO", CAST(conv_id % 4 AS VARCHAR) AS "BASE", NULL AS "RESULTADO SMS" FROM conversations WHERE turn % 2 = 0
 UNION ALL BY NAME SELECT upper(role) AS "TIPO DOCUMENTO", CAST(conv_id AS VARCHAR) AS "DOCUMENTO", text AS "TEXTO",
  'ENVIADO' AS "RESULTADO SMS" FROM conversations WHERE turn % 2 = 1""")
def consolidate_messages(spark, folder):
    """Two sheets, told apart by turn, with different columns and swapped names."""
    talk = table(spark, folder, "conversations")
    common = [
        F.col("role").alias("DESC_DOCUMENTO"),
        F.col("conv_id").cast("string").alias("ID_USUARIO"),
        F.col("text").alias("SMS"),
    ]
    even = talk.where("turn % 2 = 0").select(
        *common, F.col("role").alias("NOMBRES"), (F.col("conv_id") % 4).cast("string").alias("NOMBRE")
    )
    odd = talk.where("turn % 2 = 1").select(*common, F.lit("ENVIADO").alias("RESULTADO SMS"))
    return consolidate(even, odd)


@query("""SELECT upper(role) AS "TIPO DOCUMENTO", count(*) AS n FROM conversations GROUP BY 1""")
def consolidated_type_counts(spark, folder):
    sheet = table(spark, folder, "conversations").select(F.col("role").alias("DESC_DOCUMENTO"))
    return profile.value_counts(consolidate(sheet), "TIPO DOCUMENTO")
