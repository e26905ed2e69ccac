"""The three feeds over the supplied tables, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tamiz.operators.quality import reason_text
from tamiz.plans.contacts import clean_contacts
from tamiz.plans.folders import file_counts, files_without_valid_rows
from tamiz.plans.messages import clean_messages
from tamiz.plans.payments import clean_payments, consolidate_payments as consolidate
from tamiz.queries import raw
from tamiz.queries.registry import query


def comparable(df: DataFrame, moment: str | None = None) -> DataFrame:
    """Without the load time; moments and reasons as text."""
    shown = df.drop("fecha_carga")
    if moment:
        shown = shown.withColumn(moment, F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
    return shown.withColumn("reasons", reason_text()) if "reasons" in df.columns else shown


def sql_moment(column: str) -> str:
    """Formats tried in order, each on text of its own shape."""
    return f"""CASE WHEN regexp_full_match({column}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9:]{{8}}')
   THEN TRY_STRPTIME({column}, '%Y-%m-%d %H:%M:%S')
  WHEN regexp_full_match({column}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_STRPTIME({column}, '%Y-%m-%d') END"""


# --- payments ---------------------------------------------------------------------

SQL_BOTH = f"""WITH a AS ({raw.SQL_AGREEMENTS}), b AS ({raw.SQL_TICKETS}),
 both_feeds AS (
  SELECT nro_acuerdo, CAST(NULL AS VARCHAR) AS nro_comparendo, id_usuario AS documento,
   trim(concat(coalesce(nombres, ''), ' ', coalesce(apellidos, ''))) AS nombre_usuario, valor,
   consecutivo_cuota, fecha_liquida AS fecha, archivo_origen, nro_acuerdo AS identificador_infraccion FROM a
  UNION ALL
  SELECT NULL, coalesce(nullif(nro_comparendo, ''), nro_resolucion), id_usuario, concat(nombres, ' ', apellidos),
   CAST(CAST(trunc(coalesce(TRY_CAST(compute_0004 AS DECIMAL(28,6)), 0) + coalesce(TRY_CAST(intereses AS DECIMAL(28,6)), 0))
    AS BIGINT) AS VARCHAR),
   NULL, fecha_liquida_contrav, archivo_origen, coalesce(nullif(nro_comparendo, ''), nro_resolucion) FROM b),
 typed AS (
  SELECT sha256(concat_ws('_', coalesce(nro_acuerdo, ''), coalesce(nro_comparendo, ''), documento, nombre_usuario,
    coalesce(valor, ''), coalesce(consecutivo_cuota, ''), fecha)) AS id_registro,
   nro_acuerdo, nro_comparendo, documento, nombre_usuario, TRY_CAST(valor AS DECIMAL(15,2)) AS valor,
   {sql_moment('fecha')} AS momento, archivo_origen, identificador_infraccion FROM both_feeds),
 checked AS (
  SELECT id_registro, nro_acuerdo, nro_comparendo, documento, nombre_usuario, valor,
   strftime(momento, '%Y-%m-%d %H:%M:%S') AS fecha_pago, archivo_origen, identificador_infraccion,
   concat_ws('; ', CASE WHEN coalesce(documento, '') = '' THEN 'documento faltante' END,
    CASE WHEN nombre_usuario = '' THEN 'nombre_usuario faltante' END,
    CASE WHEN valor IS NULL THEN 'valor faltante' END, CASE WHEN valor <= 0 THEN 'valor no positivo' END,
    CASE WHEN momento IS NULL THEN 'fecha_pago faltante' END,
    CASE WHEN identificador_infraccion IS NULL THEN 'identificador_infraccion faltante' END) AS reasons FROM typed),
 failed AS (SELECT DISTINCT archivo_origen FROM (SELECT archivo_origen, id_registro FROM checked WHERE reasons = ''
  GROUP BY ALL HAVING count(*) > 1))
"""
SQL_PAYMENTS = SQL_BOTH + "SELECT * EXCLUDE (reasons) FROM checked WHERE reasons = '' AND archivo_origen NOT IN (FROM failed)"


def payments(spark, folder, **options):
    return clean_payments(raw.raw_agreements(spark, folder), raw.raw_tickets(spark, folder), **options)


@query(SQL_PAYMENTS)
def payments_valid(spark, folder):
    return comparable(payments(spark, folder).valid, "fecha_pago")


@query(SQL_BOTH + "SELECT * FROM checked WHERE reasons <> '' AND archivo_origen NOT IN (FROM failed)")
def payments_errors(spark, folder):
    return comparable(payments(spark, folder).errors, "fecha_pago")


@query(SQL_BOTH + "SELECT * FROM checked WHERE archivo_origen IN (FROM failed)")
def payments_rejected(spark, folder):
    return comparable(payments(spark, folder).rejected, "fecha_pago")


@query(SQL_BOTH + """SELECT archivo_origen, count(*) FILTER (reasons = '') AS validos,
 count(*) FILTER (reasons <> '') AS con_error FROM checked WHERE archivo_origen NOT IN (FROM failed) GROUP BY ALL""")
def payments_file_counts(spark, folder):
    return file_counts(payments(spark, folder))


@query(SQL_BOTH + "SELECT archivo_origen, 'ids duplicados' AS reason FROM failed")
def payments_failed_files(spark, folder):
    return payments(spark, folder).failed_files


@query(SQL_BOTH + """, again AS (SELECT archivo_origen, id_registro FROM checked WHERE reasons = '' GROUP BY ALL HAVING count(*) > 1)
 SELECT c.* REPLACE (CASE WHEN reasons = '' THEN 'ids duplicados' ELSE reasons END AS reasons) FROM checked c
 WHERE reasons <> '' OR (archivo_origen, id_registro) IN (FROM again)""")
def payments_duplicates_quarantined(spark, folder):
    return comparable(payments(spark, folder, on_duplicate="quarantine").errors, "fecha_pago")


@query(SQL_BOTH + """SELECT archivo_origen AS source_file, 'ids_duplicados' AS code, CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) AS detail
 FROM (SELECT archivo_origen, count(*) AS n FROM checked WHERE reasons = '' GROUP BY archivo_origen, id_registro HAVING count(*) > 1)
 GROUP BY ALL""")
def payments_duplicates_counted(spark, folder):
    return payments(spark, folder, on_duplicate="count").warnings.drop("sheet_name")


SQL_CONSOLIDATED = f"""WITH a AS ({raw.SQL_AGREEMENTS}), b AS ({raw.SQL_TICKETS})
 SELECT nro_acuerdo, CAST(NULL AS VARCHAR) AS nro_comparendo, id_usuario,
  trim(concat(coalesce(nombres, ''), ' ', coalesce(apellidos, ''))) AS nombre_usuario, valor,
  fecha_liquida AS fecha_pago, archivo_origen FROM a
 UNION ALL SELECT NULL, coalesce(nullif(nro_comparendo, ''), nro_resolucion), id_usuario, concat(nombres, ' ', apellidos),
  CAST(CAST(trunc(CAST(compute_0004 AS DECIMAL(28,6)) + CAST(intereses AS DECIMAL(28,6))) AS BIGINT) AS VARCHAR),
  fecha_liquida_contrav, archivo_origen FROM b"""


@query(SQL_CONSOLIDATED)
def consolidate_payments(spark, folder):
    return consolidate(raw.raw_agreements(spark, folder), raw.raw_tickets(spark, folder))


# --- contacts ---------------------------------------------------------------------


def sql_null(column: str) -> str:
    return f"""CASE WHEN "{column}" NOT IN ('', ' ', 'NULL', 'nan', 'NaN') THEN "{column}" END"""


SQL_CONTACTS = f"""WITH raw AS ({raw.SQL_CONTACTS}),
 named AS (SELECT coalesce({sql_null('Id Gestion Campaña')}, 'sin registro') AS "id_gestion_campaña",
  coalesce({sql_null('Tipo documento')}, 'sin registro') AS tipo_documento,
  {sql_null('Número documento')} AS documento, coalesce({sql_null('Nombre')}, 'sin registro') AS nombre_usuario,
  {sql_moment('"Fecha gestión"')} AS momento, coalesce({sql_null('Tipo llamada')}, 'Saliente') AS tipo_llamada,
  {sql_null('Código gestión')} AS codigo, "Resultado" AS resultado,
  CAST({sql_moment('"Fecha Compromiso"')} AS DATE) AS fecha_compromiso, {sql_null('Funcionario')} AS asesor,
  coalesce({sql_null('Campaña')}, 'SIN CAMPAÑA') AS campana,
  coalesce({sql_null('Teléfono')}, {sql_null('Número documento')}) AS telefono,
  "Obligación" AS obligacion, "Nro. Comparendo" AS numero_comparendo,
  coalesce(TRY_CAST("Valor" AS DECIMAL(12,2)), CAST(0 AS DECIMAL(12,2))) AS valor,
  coalesce("Obligación", "Nro. Comparendo") AS identificador_infraccion, archivo_origen, posicion FROM raw),
 coded AS (SELECT * EXCLUDE (codigo), coalesce(codigo, concat(documento, '_', telefono)) AS id_gestion FROM named),
 failed AS (SELECT DISTINCT archivo_origen FROM coded WHERE momento IS NULL),
 based AS (SELECT *, concat_ws('_', coalesce(documento, ''), coalesce(telefono, ''), coalesce(asesor, ''),
  CAST(CAST(epoch(momento) AS BIGINT) AS VARCHAR) || '.0', coalesce(id_gestion, ''),
  coalesce(identificador_infraccion, ''), coalesce(resultado, '')) AS base FROM coded
  WHERE archivo_origen NOT IN (FROM failed)),
 checked AS (SELECT sha256(concat_ws('_', base, CAST(row_number() OVER (PARTITION BY archivo_origen, base ORDER BY posicion)
  AS VARCHAR))) AS id_registro, * EXCLUDE (base, posicion, momento),
  strftime(momento, '%Y-%m-%d %H:%M:%S') AS fecha_gestion, strftime(momento, '%Y-%m-%d') AS fecha_gestion_sencilla,
  concat_ws('; ', CASE WHEN documento IS NULL THEN 'documento faltante' END,
   CASE WHEN telefono IS NULL THEN 'telefono faltante' END, CASE WHEN asesor IS NULL THEN 'asesor faltante' END,
   CASE WHEN id_gestion IS NULL THEN 'id_gestion faltante' END, CASE WHEN resultado IS NULL THEN 'resultado faltante' END)
   AS reasons FROM based)
"""


def contacts(spark, folder, **options):
    return clean_contacts(raw.raw_contacts(spark, folder), position="posicion", **options)


@query(SQL_CONTACTS + "SELECT * EXCLUDE (reasons) FROM checked WHERE reasons = ''")
def contacts_valid(spark, folder):
    return comparable(contacts(spark, folder).valid, "fecha_gestion")


@query(SQL_CONTACTS + "SELECT * FROM checked WHERE reasons <> ''")
def contacts_errors(spark, folder):
    return comparable(contacts(spark, folder).errors, "fecha_gestion")


@query(SQL_CONTACTS + """SELECT c.archivo_origen, 'fecha_gestion no válida' AS reason, count(*) AS filas
 FROM coded c JOIN failed USING (archivo_origen) GROUP BY ALL""")
def contacts_rejected(spark, folder):
    result = contacts(spark, folder)
    counted = result.rejected.groupBy("archivo_origen").agg(F.count(F.lit(1)).alias("filas"))
    return counted.join(result.failed_files, "archivo_origen").select("archivo_origen", "reason", "filas")


@query(SQL_CONTACTS + """SELECT archivo_origen, id_registro FROM checked""")
def contacts_split_groups(spark, folder):
    """The same ids when every group of the counter is treated as a hot one."""
    rows = contacts(spark, folder, hot_rows=1).rows
    return rows.select("archivo_origen", "id_registro")


# --- messages ---------------------------------------------------------------------


def sql_code(column: str) -> str:
    return f"regexp_replace(nullif(trim({sql_null(column)}), ''), '^(-?[0-9]+)\\.0$', '\\1')"


SQL_MESSAGES = f"""WITH raw AS ({raw.SQL_MESSAGES}),
 named AS (SELECT {sql_null('TIPO DOCUMENTO')} AS tipo_documento,
  coalesce({sql_code('DOCUMENTO')}, {sql_code('TELEFONO')}, {sql_code('NRO_COMPARENDO')}) AS documento,
  {sql_null('NOMBRE')} AS nombre_usuario, "FECHA" AS fecha,
  CASE WHEN regexp_matches("FECHA", '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}( 00:00:00)?$')
   THEN CAST(TRY_STRPTIME(left("FECHA", 10), '%Y-%m-%d') AS DATE) END AS fecha_sms,
  "RESULTADO" AS resultado, left({sql_null('SMS')}, 250) AS texto_sms, {sql_null('BASE')} AS base,
  {sql_code('TELEFONO')} AS telefono, {sql_code('NRO_COMPARENDO')} AS numero_comparendo, archivo_origen, posicion FROM raw),
 based AS (SELECT *, concat_ws('_', coalesce(documento, ''), coalesce(telefono, ''),
  coalesce(CAST(CAST(epoch(CAST(fecha_sms AS TIMESTAMP)) AS BIGINT) AS VARCHAR) || '.0', 'fecha_vacia'),
  coalesce(numero_comparendo, documento, ''), coalesce(base, '')) AS clave FROM named),
 checked AS (SELECT sha256(concat_ws('_', clave, CAST(row_number() OVER (PARTITION BY archivo_origen, clave ORDER BY posicion)
  AS VARCHAR))) AS id_registro, * EXCLUDE (clave, posicion, fecha), coalesce(numero_comparendo, '') AS identificador_infraccion,
  concat_ws('; ', CASE WHEN documento IS NULL THEN 'documento faltante' END,
   CASE WHEN telefono IS NULL THEN 'telefono faltante' END, CASE WHEN fecha_sms IS NULL THEN 'fecha_sms faltante' END,
   CASE WHEN telefono IS NOT NULL AND NOT regexp_full_match(telefono, '[0-9]{{7,15}}') THEN 'telefono no válido' END)
   AS reasons FROM based)
"""


def messages(spark, folder):
    return clean_messages(raw.raw_messages(spark, folder), position="posicion")


@query(SQL_MESSAGES + "SELECT * EXCLUDE (reasons) FROM checked WHERE reasons = ''")
def messages_valid(spark, folder):
    return comparable(messages(spark, folder).valid)


@query(SQL_MESSAGES + "SELECT * FROM checked WHERE reasons <> ''")
def messages_errors(spark, folder):
    return comparable(messages(spark, folder).errors)


@query(SQL_MESSAGES + """SELECT archivo_origen AS source_file, 'sin_registros_validos' AS code, CAST(count(*) AS VARCHAR) AS detail
 FROM (SELECT * REPLACE (concat(archivo_origen, '_', fecha_sms) AS archivo_origen) FROM checked)
 GROUP BY archivo_origen HAVING count(*) FILTER (reasons = '') = 0""")
def files_without_valid(spark, folder):
    """Files named by day as well, so that some hold nothing but errors."""
    result = messages(spark, folder)
    day = F.coalesce(F.col("fecha_sms").cast("string"), F.lit(""))
    result.rows = result.rows.withColumn("archivo_origen", F.concat("archivo_origen", F.lit("_"), day))
    return files_without_valid_rows(result).drop("sheet_name")
