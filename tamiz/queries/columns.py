"""Column functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamiz.functions import dates, identity, numbers, text
from tamiz.operators import counter
from tamiz.operators.schema import fill_defaults as fill
from tamiz.queries.registry import query, table

# The tables hold clean values; the same CASE adds untidy ones in both engines.
UNTIDY = """CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'NULL' WHEN 2 THEN ' ' WHEN 3 THEN 'nan'
 WHEN 4 THEN 'NaN' WHEN 5 THEN ' null ' ELSE event_type END"""
CLEAN = f"CASE WHEN {UNTIDY} IN ('', ' ', 'NULL', 'nan', 'NaN') THEN NULL ELSE {UNTIDY} END"

NUMBER = """CASE event_id % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN 'inf' WHEN 3 THEN '1,000'
 WHEN 4 THEN concat('  ', CAST(event_id AS STRING), ' ') WHEN 5 THEN concat(CAST(event_id AS STRING), '.0')
 WHEN 6 THEN concat('-', CAST(event_id AS STRING), '.50') ELSE CAST(CAST(value AS DECIMAL(12,2)) AS STRING) END"""

DATE_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN {ymd} WHEN 1 THEN {short} WHEN 2 THEN concat({ymd}, ' 00:00:00')
 WHEN 3 THEN concat({ymd}, ' 10:11:12') WHEN 4 THEN {dmy} WHEN 5 THEN '2024-02-30' ELSE concat(' ', {ymd}, ' ') END"""
SPARK_DATE = DATE_TEXT.format(
    ymd="date_format(o_orderdate, 'yyyy-MM-dd')", short="date_format(o_orderdate, 'y-M-d')",
    dmy="date_format(o_orderdate, 'dd/MM/yyyy')",
)
SQL_DATE = DATE_TEXT.format(
    ymd="strftime(o_orderdate, '%Y-%m-%d')",
    short="concat(year(o_orderdate), '-', month(o_orderdate), '-', day(o_orderdate))",
    dmy="strftime(o_orderdate, '%d/%m/%Y')",
)
SQL_NUMBER = NUMBER.replace("STRING", "VARCHAR")


def untidy_events(spark, folder):
    events = table(spark, folder, "events")
    cleaned = text.null_tokens(F.col("texto"), text.WORKBOOK_NULLS)
    return events.withColumn("texto", F.expr(UNTIDY)).withColumn("limpio", cleaned)


@query(f"SELECT event_id, {UNTIDY} AS texto, {CLEAN} AS limpio FROM events")
def null_tokens(spark, folder):
    return untidy_events(spark, folder).select("event_id", "texto", "limpio")


@query(f"""SELECT event_id, coalesce({CLEAN}, 'Saliente') AS tipo_llamada,
 coalesce({CLEAN}, 'SIN CAMPAÑA') AS campana, coalesce({CLEAN}, '') AS identificador FROM events""")
def fill_defaults(spark, folder):
    df = untidy_events(spark, folder).select(
        "event_id",
        *[F.col("limpio").alias(c) for c in ("tipo_llamada", "campana", "identificador")],
    )
    return fill(df, {"tipo_llamada": "Saliente", "campana": "SIN CAMPAÑA", "identificador": ""})


@query(f"""SELECT event_id, coalesce({CLEAN}, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END,
 json_extract_string(props, '$.k')) AS documento FROM events""")
def coalesce_chain(spark, folder):
    phone = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string"))
    ticket = F.get_json_object("props", "$.k")
    return untidy_events(spark, folder).select(
        "event_id", F.coalesce("limpio", phone, ticket).alias("documento")
    )


@query(f"""WITH t AS (SELECT event_id, CAST(user_id AS VARCHAR) AS documento,
   coalesce(nullif({CLEAN}, ''), CAST(user_id AS VARCHAR)) AS telefono,
   CASE WHEN event_id % 3 = 0 THEN event_type END AS codigo FROM events)
 SELECT event_id, telefono,
   coalesce(nullif(codigo, ''), concat(trim(documento), '_', trim(telefono))) AS id_gestion,
   CASE WHEN codigo IS NOT NULL THEN codigo ELSE documento END AS infraccion FROM t""")
def conditional_fill(spark, folder):
    df = untidy_events(spark, folder).select(
        "event_id",
        F.col("user_id").cast("string").alias("documento"),
        "limpio",
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("codigo"),
    )
    filled = df.withColumn("telefono", text.first_filled(F.col("limpio"), F.col("documento")))
    code = text.joined_code(F.col("documento"), F.col("telefono"))
    return filled.select(
        "event_id",
        "telefono",
        text.first_filled(F.col("codigo"), code).alias("id_gestion"),
        F.when(F.col("codigo").isNotNull(), F.col("codigo")).otherwise(F.col("documento")).alias("infraccion"),
    )


@query(f"""WITH t AS (SELECT event_id, {SQL_NUMBER} AS numero FROM events)
 SELECT event_id, numero, TRY_CAST(trim(numero) AS DECIMAL(18,2)) AS valor,
  CASE WHEN TRY_CAST(trim(numero) AS DECIMAL(38,10)) = floor(TRY_CAST(trim(numero) AS DECIMAL(38,10)))
   THEN CAST(TRY_CAST(trim(numero) AS DECIMAL(38,10)) AS BIGINT) END AS entero FROM t""")
def numeric_coerce(spark, folder):
    number = F.col("numero")
    return table(spark, folder, "events").select("event_id", F.expr(NUMBER).alias("numero")).select(
        "event_id", "numero",
        numbers.to_decimal(number).alias("valor"),
        numbers.to_bigint(number).alias("entero"),
    )


PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS {text})"
TAX = "CASE WHEN l_linenumber % 7 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(4,2)) AS {text}) END"
SQL_PRICE, SQL_TAX = (f"CAST({e.format(text='VARCHAR')} AS DECIMAL(28,6))" for e in (PRICE, TAX))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(CAST(trunc({SQL_PRICE} + coalesce({SQL_TAX}, 0)) AS BIGINT) AS VARCHAR) AS valor,
  CAST(CAST(trunc({SQL_PRICE} + {SQL_TAX}) AS BIGINT) AS VARCHAR) AS valor_estricto FROM lineitem""")
def truncated_sum(spark, folder):
    a, b = F.expr(PRICE.format(text="STRING")), F.expr(TAX.format(text="STRING"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        numbers.truncated_sum(a, b).alias("valor"),
        numbers.truncated_sum(a, b, null_as_zero=False).alias("valor_estricto"),
    )


@query(f"""WITH t AS (SELECT o_orderkey, {SQL_DATE} AS fecha FROM orders),
 u AS (SELECT *, regexp_replace(trim(fecha), ' 00:00:00(\\.0+)?$', '') AS dia FROM t)
 SELECT o_orderkey, CASE WHEN regexp_full_match(dia, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')
  THEN CAST(TRY_STRPTIME(dia, '%Y-%m-%d') AS DATE) END AS fecha_sms FROM u""")
def parse_dates_strict(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", dates.parse_date_strict(F.expr(SPARK_DATE)).alias("fecha_sms")
    )


SQL_MOMENT = """CASE WHEN regexp_full_match(trim(fecha), '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}')
   THEN TRY_STRPTIME(trim(fecha), '%Y-%m-%d %H:%M:%S')
  WHEN regexp_full_match(trim(fecha), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_STRPTIME(trim(fecha), '%Y-%m-%d')
  WHEN regexp_full_match(trim(fecha), '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN TRY_STRPTIME(trim(fecha), '%d/%m/%Y') END"""


@query(f"""WITH t AS (SELECT o_orderkey, {SQL_DATE} AS fecha FROM orders),
 u AS (SELECT o_orderkey, {SQL_MOMENT} AS momento FROM t)
 SELECT o_orderkey, strftime(momento, '%Y-%m-%d %H:%M:%S') AS momento, CAST(momento AS DATE) AS dia,
  CAST(CAST(epoch(momento) AS BIGINT) AS VARCHAR) || '.0' AS segundos FROM u""")
def parse_dates_multi(spark, folder):
    moment = dates.parse_timestamp(F.expr(SPARK_DATE))
    return table(spark, folder, "orders").select("o_orderkey", moment.alias("m")).select(
        "o_orderkey",
        F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("momento"),
        F.to_date("m").alias("dia"),
        dates.epoch_text(F.col("m")).alias("segundos"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS fecha FROM orders")
def date_text(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", dates.day_text(F.col("o_orderdate")).alias("fecha")
    )


@query("""SELECT conv_id, turn, trim(text, e' \\t\\n\\r') AS recortado, upper(role) AS tipo,
  trim(concat(coalesce(CASE WHEN turn % 2 = 0 THEN role END, ''), ' ',
   coalesce(CASE WHEN turn % 3 = 0 THEN CAST(conv_id AS VARCHAR) END, ''))) AS nombre,
  split_part(concat(conv_id, '.', turn), '.', 1) AS entero, CAST(turn AS VARCHAR) AS turno,
  role LIKE 'us%' AS es_usuario
 FROM conversations""")
def text_ops(spark, folder):
    first = F.when(F.col("turn") % 2 == 0, F.col("role"))
    last = F.when(F.col("turn") % 3 == 0, F.col("conv_id").cast("string"))
    dotted = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        text.strip(F.col("text")).alias("recortado"),
        F.upper("role").alias("tipo"),
        text.full_name(first, last).alias("nombre"),
        F.substring_index(dotted, ".", 1).alias("entero"),
        F.col("turn").cast("string").alias("turno"),
        F.startswith("role", F.lit("us")).alias("es_usuario"),
    )


@query("""SELECT conv_id, turn, left(text, 250) AS texto_sms, CAST(length(text) AS BIGINT) AS largo,
 left(role, 50) AS base FROM conversations""")
def varchar_truncate(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        text.truncate(F.col("text"), 250).alias("texto_sms"),
        F.length("text").cast("bigint").alias("largo"),
        text.truncate(F.col("role"), 50).alias("base"),
    )


PHONE_TEXT = """CASE c_custkey % 6 WHEN 0 THEN concat('300', CAST(1000000 + c_custkey AS {text})) WHEN 1 THEN '123456'
 WHEN 2 THEN concat('+57', CAST(3000000000 + c_custkey AS {text})) WHEN 3 THEN concat(CAST(3000000000 + c_custkey AS {text}), '.0')
 WHEN 4 THEN concat(CAST(3000000000 + c_custkey AS {text}), {newline}) ELSE NULL END"""
SQL_PHONE = PHONE_TEXT.format(text="VARCHAR", newline="chr(10)")


@query(f"""SELECT c_custkey, {SQL_PHONE} AS telefono,
 regexp_replace({SQL_PHONE}, '^(-?[0-9]+)\\.0$', '\\1') AS entero,
 coalesce(regexp_full_match({SQL_PHONE}, '[0-9]{{7,15}}'), false) AS valido FROM customer""")
def phone_regex(spark, folder):
    phone = F.expr(PHONE_TEXT.format(text="STRING", newline="char(10)"))
    return table(spark, folder, "customer").select(
        "c_custkey",
        phone.alias("telefono"),
        text.integral_text(phone).alias("entero"),
        text.is_phone(phone).alias("valido"),
    )


@query("""SELECT o_orderkey, sha256(concat_ws('_', CAST(o_orderkey AS VARCHAR), coalesce(nullif(o_orderstatus, 'P'), ''),
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) || '.0'))
  AS id_registro FROM orders""")
def record_id(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        identity.record_id(
            F.col("o_orderkey"),
            F.nullif("o_orderstatus", F.lit("P")),
            F.col("o_totalprice").cast("decimal(15,2)"),
            dates.epoch_text(F.col("o_orderdate")),
        ).alias("id_registro"),
    )


@query("""WITH t AS (SELECT event_id, concat_ws('_', CAST(user_id AS VARCHAR), event_type,
  CAST(CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS VARCHAR) || '.0') AS base FROM events)
 SELECT event_id, sha256(concat_ws('_', base,
  CAST(row_number() OVER (PARTITION BY base ORDER BY event_id) AS VARCHAR))) AS id_registro FROM t""")
def record_id_counter(spark, folder):
    base = identity.preimage(
        F.col("user_id"), F.col("event_type"), dates.epoch_text(F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    )
    df = table(spark, folder, "events").select("event_id", base.alias("base"))
    counted = counter.group_counter(df, ["base"], "n", position="event_id")
    return counted.select(
        "event_id", identity.record_id(F.col("base"), F.col("n")).alias("id_registro")
    )


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS contador
 FROM lineitem""")
def group_counter(spark, folder):
    lines = table(spark, folder, "lineitem")
    return counter.group_counter(lines, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "contador"
    )


@query("""SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS contador
 FROM events""")
def group_counter_hot_position(spark, folder):
    """A handful of groups hold everything, so every group is cut into buckets."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    return counter.group_counter(events, ["event_type"], position="event_id", hot_rows=100)


@query("""SELECT l_returnflag, l_linestatus, dia_par, row_number() OVER
  (PARTITION BY l_returnflag, l_linestatus, dia_par) AS contador
 FROM (SELECT l_returnflag, l_linestatus, CAST(day(l_shipdate) AS BIGINT) % 2 AS dia_par FROM lineitem)""")
def group_counter_hot_copies(spark, folder):
    """Groups made of identical rows, which are counted before they are shuffled."""
    copies = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus",
        (F.dayofmonth("l_shipdate").cast("bigint") % 2).alias("dia_par"),
    )
    return counter.group_counter(copies, copies.columns, hot_rows=100)
