"""The supplied tables as raw feeds, in Spark and in SQL.

Money and moments become text, and a shared rule on the row keys adds the untidy
cells a feed has: missing names, unreadable dates, short phones, repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.queries.registry import table

# --- payments: agreements from orders, tickets from lineitem ---------------------

AGREEMENTS = """
SELECT CAST(o_orderkey AS {text}) AS nro_acuerdo, CAST(o_custkey AS {text}) AS id_usuario,
 CASE WHEN o_orderkey % 53 <> 0 THEN c_name END AS nombres,
 CASE WHEN o_orderkey % 53 <> 0 THEN c_mktsegment END AS apellidos,
 CASE WHEN o_orderkey % 50 = 0 THEN '0' WHEN o_orderkey % 51 = 0 THEN 'abc'
  ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS {text}) END AS valor,
 CASE WHEN o_orderkey % 59 = 0 THEN '2024-02-30' ELSE {day} END AS fecha_liquida,
 o_orderpriority AS consecutivo_cuota,
 concat('A_', CAST(year(o_orderdate) AS {text})) AS archivo_origen
FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey
"""

# Some lines of 1996 come twice, which fails that one file.
TICKETS = """
SELECT CASE WHEN l_linenumber % 5 <> 0 THEN
  concat(CAST(l_orderkey AS {text}), '-', CAST(l_linenumber AS {text}), '-', CAST(l_partkey AS {text})) ELSE '' END
  AS nro_comparendo,
 CAST(l_quantity AS {integer}) AS nro_recibo,
 {moment} AS fecha_liquida_contrav,
 CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS {text}) AS compute_0004,
 CAST(l_suppkey AS {text}) AS id_usuario, 'Proveedor' AS nombres, CAST(l_suppkey AS {text}) AS apellidos,
 CAST(l_partkey AS {text}) AS nro_resolucion,
 CASE WHEN l_linenumber % 7 <> 0 THEN
  CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(4,2)) AS {text}) END AS intereses,
 concat('B_', CAST(year(l_shipdate) AS {text})) AS archivo_origen
FROM (SELECT * FROM {lineitem} UNION ALL SELECT * FROM {lineitem}
 WHERE year(l_shipdate) = 1996 AND l_linenumber = 1 AND l_orderkey % 100 = 7)
"""

SPARK_PAYMENTS = dict(
    text="STRING", integer="STRING",
    day="date_format(o_orderdate, 'yyyy-MM-dd')",
    moment="date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')",
    orders="{orders}", customer="{customer}", lineitem="{lineitem}",
)
SQL_PAYMENTS = dict(
    text="VARCHAR", integer="VARCHAR",
    day="strftime(o_orderdate, '%Y-%m-%d')",
    moment="strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')",
    orders="orders", customer="customer", lineitem="lineitem",
)
SQL_AGREEMENTS, SQL_TICKETS = (q.format(**SQL_PAYMENTS) for q in (AGREEMENTS, TICKETS))


def raw_agreements(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        AGREEMENTS.format(**SPARK_PAYMENTS),
        orders=table(spark, folder, "orders"), customer=table(spark, folder, "customer"),
    )


def raw_tickets(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(TICKETS.format(**SPARK_PAYMENTS), lineitem=table(spark, folder, "lineitem"))


# --- contacts from events ----------------------------------------------------------

CONTACTS = """
SELECT concat('G', CAST(event_id AS {text})) AS `Id Gestion Campaña`,
 CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'CC' END AS `Tipo documento`,
 CAST(user_id AS {text}) AS `Número documento`,
 CASE WHEN event_id % 3 = 0 THEN 'nan' ELSE concat('Usuario ', CAST(user_id AS {text})) END AS `Nombre`,
 CASE WHEN {date} = '2024-01-15' AND event_id % 5 = 0 THEN 'ayer' ELSE {hour} END AS `Fecha gestión`,
 CASE WHEN event_id % 6 = 0 THEN '' ELSE 'Entrante' END AS `Tipo llamada`,
 CASE WHEN event_id % 13 = 0 THEN 'NULL' ELSE {k} END AS `Código gestión`,
 event_type AS `Resultado`,
 CASE WHEN event_id % 8 = 0 THEN {date} END AS `Fecha Compromiso`,
 CASE WHEN event_id % 11 <> 0 THEN event_type END AS `Funcionario`,
 CASE WHEN event_id % 9 = 0 THEN 'NaN' ELSE 'C1' END AS `Campaña`,
 CASE WHEN event_id % 17 <> 0 THEN concat('300', lpad(CAST(user_id AS {text}), 7, '0')) ELSE '' END AS `Teléfono`,
 CASE WHEN event_id % 2 = 0 THEN {k} END AS `Obligación`,
 CASE WHEN event_id % 5 <> 0 THEN concat('N-', {k}) END AS `Nro. Comparendo`,
 CASE WHEN event_id % 19 = 0 THEN 'abc' ELSE CAST(CAST(value AS DECIMAL(12,2)) AS {text}) END AS `Valor`,
 concat('E_', {date}) AS archivo_origen, event_id AS posicion
FROM {events}
"""
SPARK_CONTACTS = CONTACTS.format(
    text="STRING", date="date_format(ts, 'yyyy-MM-dd')", hour="date_format(ts, 'yyyy-MM-dd HH:00:00')",
    k="get_json_object(props, '$.k')", events="{events}",
)
SQL_CONTACTS = CONTACTS.format(
    text="VARCHAR", date="strftime(ts, '%Y-%m-%d')", hour="strftime(ts, '%Y-%m-%d %H:00:00')",
    k="json_extract_string(props, '$.k')", events="events",
).replace("`", '"')


def raw_contacts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(SPARK_CONTACTS, events=table(spark, folder, "events"))


# --- messages from conversations ---------------------------------------------------

MESSAGES = """
SELECT CASE WHEN turn % 2 = 0 THEN 'CC' END AS `TIPO DOCUMENTO`,
 CASE WHEN turn % 3 = 0 THEN ' ' ELSE CAST(conv_id AS {text}) END AS `DOCUMENTO`,
 role AS `NOMBRE`,
 CASE WHEN turn % 5 = 4 THEN 'ayer' WHEN turn % 5 = 3 THEN concat({day}, ' 00:00:00') ELSE {day} END AS `FECHA`,
 'ENVIADO' AS `RESULTADO`, text AS `SMS`, role AS `BASE`,
 CASE WHEN turn % 4 = 3 THEN '12345' WHEN turn % 7 = 6 THEN 'NULL'
  ELSE concat('300', lpad(CAST(conv_id AS {text}), 7, '0'), CASE WHEN turn % 2 = 0 THEN '.0' ELSE '' END) END AS `TELEFONO`,
 CASE WHEN turn % 2 = 1 THEN concat(CAST(conv_id AS {text}), '-', CAST(turn AS {text})) END AS `NRO_COMPARENDO`,
 concat('M_', CAST(conv_id % 4 AS {text})) AS archivo_origen,
 conv_id * 100000 + turn AS posicion
FROM {conversations}
"""
SPARK_MESSAGES = MESSAGES.format(
    text="STRING", day="date_format(date_add(DATE'2024-01-01', CAST(turn AS INT)), 'yyyy-MM-dd')",
    conversations="{conversations}",
)
SQL_MESSAGES = MESSAGES.format(
    text="VARCHAR", day="strftime(DATE '2024-01-01' + CAST(turn AS INT), '%Y-%m-%d')",
    conversations="conversations",
).replace("`", '"')


def raw_messages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(SPARK_MESSAGES, conversations=table(spark, folder, "conversations"))
