"""Files written from the supplied tables, then scanned."""

from __future__ import annotations

import io
import zipfile
from contextlib import contextmanager
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from tamiz import feeds
from tamiz.plans.folders import (
    concatenated_folder, consolidated_folder, file_counts, files_without_valid_rows, payments_folder,
)
from tamiz.plans.payments import clean_payments
from tamiz.plans.load import storage_schema
from tamiz.queries import raw
from tamiz.queries.loads import SQL_AGREEMENT_ROWS
from tamiz.queries.feeds import SQL_BOTH, SQL_CONSOLIDATED, comparable
from tamiz.queries.registry import query, table
from tamiz.session import discard, passing_shuffles, scratch
from tamiz.sinks.one_file import join_files
from tamiz.sinks.tables import read_target
from tamiz.sources.files import decode_content
from tamiz.sources.text import read_text, scan_text
from tamiz.sources.workbook import parse_workbooks, split_sheets
from tamiz.sources.workbook_source import scan_workbooks
from tamiz.streaming.file_drop import load_dropped


def write_text(df: DataFrame, folder: str, prefix: str, suffix: str = ".txt", encoding: str = "ISO-8859-1") -> None:
    """Tab-separated files called ``<prefix> <n><suffix>``, one per partition."""
    parts = f"{folder}/_{prefix.replace(' ', '_')}"
    df.write.options(sep="\t", encoding=encoding, header=True, escape='"').csv(parts)
    name_files(df.sparkSession, parts, folder, prefix, suffix)


def name_files(spark, parts: str, folder: str, prefix: str, suffix: str = ".txt") -> None:
    # The writer names its own files, so they are given their feed's names afterwards.
    hadoop = spark._jvm.org.apache.hadoop.fs
    source = hadoop.Path(parts)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in system.listStatus(source) if s.getPath().getName().startswith("part-")]
    for n, path in enumerate(names):
        system.rename(path, hadoop.Path(f"{folder}/{prefix} {n}{suffix}"))


def write_whole(df: DataFrame, folder: str, name: str, encoding: str = "ISO-8859-1") -> None:
    """One tab-separated file ``<name>`` with a header, whatever its size: every task writes its own lines of it."""
    parts = f"{folder}/_{name.replace(' ', '_')}"
    options = dict(sep="\t", encoding=encoding, escape='"')
    head = df.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"`{c}` string" for c in df.columns))
    head.coalesce(1).write.options(**options).csv(f"{parts}/head")
    df.write.options(**options).csv(f"{parts}/body")
    join_files(df.sparkSession, [f"{parts}/head", f"{parts}/body"], f"{folder}/{name}")


def write_whole_lines(spark, head: str, lines: DataFrame | str, folder: str, name: str) -> None:
    """The same from lines that are made already, or from a folder of them."""
    parts = f"{folder}/_{name.replace(' ', '_')}"
    latin(spark.createDataFrame([(head,)], "value string").coalesce(1)).write.text(f"{parts}/head")
    if not isinstance(lines, str):
        latin(lines).write.text(f"{parts}/body")
        lines = f"{parts}/body"
    join_files(spark, [f"{parts}/head", lines], f"{folder}/{name}")


def latin(lines: DataFrame) -> DataFrame:
    """Lines whose ``value`` the text writer puts down in Latin-1."""
    return lines.withColumn("value", F.encode("value", "ISO-8859-1").cast("string"))


@query("""SELECT c_custkey, concat(c_name, ' Peña') AS nombre, CAST(c_acctbal AS DECIMAL(12,2)) AS saldo,
 c_mktsegment FROM customer""")
def scan_text_roundtrip(spark, folder):
    place = scratch(spark, "text")
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(" Peña")).alias("nombre"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("saldo"), "c_mktsegment",
    )
    write_text(customers, place, "Clientes")
    text = read_text(spark, place, customers.columns)
    return text.select(*[F.col(c).try_cast(t).alias(c) for c, t in customers.dtypes])


SHOWN = ["id_registro", "nro_acuerdo", "nro_comparendo", "documento", "nombre_usuario", "valor", "fecha_pago",
         "identificador_infraccion", "reasons", "familia"]
FAMILY = "CASE WHEN archivo_origen LIKE 'A%' THEN 'Ap' ELSE 'Co' END AS familia"


def write_payment_folder(spark, folder):
    """Both families, one with other column order and upper-case suffixes, and a stranger.

    The lines that come twice keep to one file, so that file fails whole.
    """
    place = scratch(spark, "folder")
    with passing_shuffles(spark):
        write_text(raw.raw_agreements(spark, folder).drop("archivo_origen"), place, feeds.AGREEMENT_PREFIX)
    tickets = raw.raw_tickets(spark, folder)
    swapped = tickets.select("intereses", F.lit("x").alias("extra"), *tickets.columns[:-2])
    doubled = tickets["archivo_origen"] == "B_1996"
    write_text(swapped.where(~doubled), place, feeds.TICKET_PREFIX, ".TXT")
    # All lines of one year as one file, as the sender would write them.
    write_whole(swapped.where(doubled), place, f"{feeds.TICKET_PREFIX} 1996 0.txt")
    write_text(table(spark, folder, "supplier"), place, "Otros")
    return place


def cleaned_payment_folder(spark, folder):
    """That folder cleaned. Its files are deleted once they are read: what follows needs only what is stored."""
    place = write_payment_folder(spark, folder)
    return payments_folder(spark, place, once_read=lambda: discard(spark, place))


@query(SQL_BOTH + f"""SELECT * EXCLUDE (archivo_origen) REPLACE (nullif(reasons, '') AS reasons), {FAMILY}
 FROM checked WHERE archivo_origen NOT IN (FROM failed)""")
def scan_folder_routed(spark, folder):
    result = cleaned_payment_folder(spark, folder)
    family = F.substring("archivo_origen", 1, 2).alias("familia")
    rows = comparable(result.rows, "fecha_pago").select("*", family)
    return rows.withColumn("reasons", F.nullif("reasons", F.lit(""))).select(*SHOWN)


@query(f"""SELECT 'Comparendos pagados 1996' AS familia, 'ids duplicados' AS reason FROM lineitem
  WHERE year(l_shipdate) = 1996 AND l_linenumber = 1 AND l_orderkey % 100 = 7 GROUP BY ALL
 UNION SELECT 'Otros', 'tipo de archivo no reconocido' FROM supplier""")
def scan_folder_failed(spark, folder):
    failed = cleaned_payment_folder(spark, folder).failed_files
    family = F.regexp_replace("archivo_origen", r" \d+\.(txt|TXT)\z", "")
    return failed.select(family.alias("familia"), "reason").distinct()


@query(f"""SELECT 'Ap pagados' AS familia, count(*) AS filas, 7 AS columnas FROM ({raw.SQL_AGREEMENTS})
 UNION ALL SELECT 'Comparendos pagados', count(*) FILTER (archivo_origen <> 'B_1996'), 10 FROM ({raw.SQL_TICKETS})
 UNION ALL SELECT 'Comparendos pagados 1996', count(*) FILTER (archivo_origen = 'B_1996'), 10 FROM ({raw.SQL_TICKETS})
 UNION ALL SELECT 'Otros', count(*), 4 FROM supplier""")
def scan_file_shapes(spark, folder):
    shapes = scan_text(spark, write_payment_folder(spark, folder)).shapes()
    family = F.regexp_replace("archivo_origen", r" \d+\.(txt|TXT)\z", "")
    return shapes.groupBy(family.alias("familia")).agg(
        F.sum("filas").alias("filas"), F.max("columnas").cast("int").alias("columnas")
    )


@query(f"""SELECT * EXCLUDE (archivo_origen) REPLACE (TRY_CAST(nro_acuerdo AS BIGINT) AS nro_acuerdo,
   TRY_CAST(id_usuario AS BIGINT) AS id_usuario) FROM ({raw.SQL_AGREEMENTS})
 UNION ALL BY NAME SELECT * EXCLUDE (archivo_origen) REPLACE (TRY_CAST(id_usuario AS BIGINT) AS id_usuario,
   nullif(nro_comparendo, '') AS nro_comparendo), 'x' AS extra FROM ({raw.SQL_TICKETS})
 UNION ALL BY NAME SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey,
  CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS s_acctbal FROM supplier""")
def scan_folder_concatenated(spark, folder):
    """Every column of every file, whatever the headers."""
    rows = concatenated_folder(spark, write_payment_folder(spark, folder))[0].drop("Fuente_Archivo")
    return rows.withColumn("s_acctbal", F.col("s_acctbal").try_cast("decimal(12,2)").cast("string"))


@query(SQL_CONSOLIDATED.replace(", archivo_origen FROM", " FROM") + """
 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL FROM supplier""")
def scan_folder_consolidated(spark, folder):
    return consolidated_folder(spark, write_payment_folder(spark, folder))[0].drop("archivo_origen")


# What a Latin-1 file with trimmed cells can hold; line breaks stay.
ASCII, ENDS = "[^\\n\\x20-\\x7E]", "^\\s+|\\s+$"


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, false AS malformed,
  nullif(regexp_replace(regexp_replace(text, '{ASCII}', '', 'g'), '{ENDS}', '', 'g'), '') AS text FROM conversations""")
def scan_quoted_lines(spark, folder):
    """Cells that hold line breaks, read without any option."""
    place = scratch(spark, "quoted")
    text = F.regexp_replace(F.regexp_replace("text", ASCII, ""), ENDS, "").alias("text")
    wanted = ["conv_id", "turn", "role", "text"]
    write_text(table(spark, folder, "conversations").select("conv_id", "turn", "role", text), place, "Turnos")
    return scan_text(spark, place, wanted).rows.select(*wanted, "malformed")


@contextmanager
def split_bytes(spark, size: int):
    """Files are read in splits of so many bytes, as if they were large."""
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# Notes with a line break, quotes and a separator; and a quote that opens nothing.
NOTES = "CASE WHEN {k} % 50 = 7 THEN concat('dos', chr(10), 'líneas', chr(9), '\"y\"') WHEN {k} % 50 = 8 THEN '5\" tubo' ELSE 'sin nota' END"
SQL_NOTES = NOTES.replace('\\"', '"').format(k="l_orderkey")


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS pedido, CAST(l_linenumber AS VARCHAR) AS linea, {SQL_NOTES} AS nota,
 CASE WHEN l_orderkey % 3 = 0 THEN 'uno' ELSE 'varios' END AS familia FROM lineitem""")
def scan_quoted_hot_file(spark, folder):
    """A third of all rows in one file whose cells hold line breaks and stray quotes, read in many splits."""
    place = scratch(spark, "hot")
    key = F.col("l_orderkey")
    broken = F.lit('"dos\nlíneas\t""y"""')
    note = F.when(key % 50 == 7, broken).when(key % 50 == 8, '5" tubo').otherwise("sin nota")
    rows = table(spark, folder, "lineitem").select(
        (key % 3 == 0).alias("hot"), F.concat_ws("\t", key.cast("string"), F.col("l_linenumber").cast("string"), note).alias("value")
    )
    head = "pedido\tlinea\tnota"
    write_whole_lines(spark, head, rows.where("hot").select("value"), place, "uno 0 0.txt")
    dealt = rows.where("NOT hot").select("value", F.pmod(F.hash("value"), F.lit(4)).alias("part"))
    latin(dealt).write.partitionBy("part").text(f"{place}/_varios")
    for n in range(4):
        write_whole_lines(spark, head, f"{place}/_varios/part={n}", place, f"varios {n} 0.txt")
    with split_bytes(spark, 1 << 16):
        scan = scan_text(spark, place, ["pedido", "linea", "nota"])
    family = F.substring_index("archivo_origen", " ", 1).alias("familia")
    return scan.rows.where("NOT malformed").select("pedido", "linea", "nota", family)


WIDE = 2_000


@query(f"""SELECT s_suppkey AS clave, s_name AS nombre, CAST(s_suppkey * 3 + {WIDE - 1} AS VARCHAR) AS ultima, false AS malformed FROM supplier
 UNION ALL SELECT n_nationkey, n_name, NULL, false FROM nation
 UNION ALL SELECT c_custkey, c_name, NULL, c_custkey % 100 = 0 FROM customer""")
def scan_folder_shapes_mixed(spark, folder):
    """A file of 2,000 columns among narrow ones; one family has a cell beyond its header now and then."""
    place = scratch(spark, "shapes")
    suppliers = table(spark, folder, "supplier")
    # The wide rows as text: their columns would be no readable plan.
    cells = F.transform(F.sequence(F.lit(0), F.lit(WIDE - 2)), lambda i: (F.col("s_suppkey") * 3 + i + 1).cast("string"))
    names = "\t".join(["clave", *[f"c{i}" for i in range(1, WIDE - 2)], "ultima", "nombre"])
    line = F.concat_ws("\t", F.col("s_suppkey").cast("string"), F.slice(cells, 2, WIDE - 1), F.col("s_name"))
    write_whole_lines(spark, names, suppliers.select(line.alias("value")), place, "ancho 0.txt")
    nations = table(spark, folder, "nation").select(F.col("n_name").alias("nombre"), F.col("n_nationkey").alias("clave"))
    write_text(nations, place, "naciones")
    more = F.when(F.col("c_custkey") % 100 == 0, "más")
    named = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.coalesce(more, F.lit("")))
    customers = table(spark, folder, "customer").select(named.alias("value"))
    write_whole_lines(spark, "clave\tnombre", customers, place, "clientes 0.txt")
    rows = scan_text(spark, place, ["clave", "nombre", "ultima"]).rows
    return rows.select(F.col("clave").cast("bigint").alias("clave"), "nombre", "ultima", "malformed")


@query("""SELECT c_custkey AS clave, concat(c_name, ' Peña') AS nombre,
 CASE WHEN c_custkey % 2 = 0 THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding FROM customer""")
def folder_mixed_encodings(spark, folder):
    """Files in UTF-8 and in Latin-1, each read in its own."""
    place = scratch(spark, "encodings")
    customers = table(spark, folder, "customer").select("c_custkey", F.concat("c_name", F.lit(" Peña")).alias("nombre"))
    for rest, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        write_text(customers.where(F.col("c_custkey") % 2 == rest), place, f"Clientes {rest}", encoding=encoding)
    scan = scan_text(spark, place, ["c_custkey", "nombre"], encoding="auto")
    rows = scan.rows.join(scan.headers.select("archivo_origen", "encoding"), "archivo_origen")
    return rows.select(F.col("c_custkey").cast("bigint").alias("clave"), "nombre", "encoding")


@query(SQL_AGREEMENT_ROWS + """SELECT nro_acuerdo, fecha_pago, nro_acuerdo[-1:] IN ('1', '3', '5', '7', '9') AS impar
 FROM checked WHERE fecha_pago IS NOT NULL""")
def dates_inferred(spark, folder):
    """Files that write days first and files that write months first: most dates alone could be either."""
    place = scratch(spark, "orders")
    agreements = raw.raw_agreements(spark, folder).drop("archivo_origen")
    odd = F.col("nro_acuerdo").cast("bigint") % 2 == 1
    day = F.split("fecha_liquida", "-")
    for name, some, order in (("par", ~odd, (2, 1, 0)), ("impar", odd, (1, 2, 0))):
        written = agreements.withColumn("fecha_liquida", F.concat_ws("/", *[day[i] for i in order]))
        write_text(written.where(some), place, f"{feeds.AGREEMENT_PREFIX} {name}")
    rows = payments_folder(spark, place, dates="by_file").rows.where("fecha_pago IS NOT NULL")
    return rows.select(
        "nro_acuerdo", F.date_format("fecha_pago", "yyyy-MM-dd HH:mm:ss").alias("fecha_pago"), odd.alias("impar")
    )


@query(SQL_AGREEMENT_ROWS + """SELECT archivo_origen AS archivo, CASE WHEN archivo_origen = 'A_1996'
 THEN 'fila con más campos que el encabezado' ELSE 'leído' END AS estado,
 CASE WHEN archivo_origen = 'A_1996' THEN 0 ELSE count(*) END AS filas FROM checked GROUP BY archivo_origen""")
def consolidated_malformed(spark, folder):
    """One year's file has a cell beyond its header, and fails whole; the others are read."""
    place = scratch(spark, "malformed")
    agreements = raw.raw_agreements(spark, folder)
    years = [r[0] for r in agreements.select("archivo_origen").distinct().collect()]
    for year in years:
        rows, name = agreements.where(F.col("archivo_origen") == year).drop("archivo_origen"), f"{feeds.AGREEMENT_PREFIX} {year} 0.txt"
        if year == "A_1996":
            last = F.concat(F.col("consecutivo_cuota"), F.lit("\tmás"))
            line = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in feeds.AGREEMENT_COLUMNS[:-1]], last)
            write_whole_lines(spark, "\t".join(feeds.AGREEMENT_COLUMNS), rows.select(line.alias("value")), place, name)
        else:
            write_whole(rows, place, name)
    rows, failed = consolidated_folder(spark, place)
    year = F.regexp_extract("archivo_origen", r"(A_\d+)", 1).alias("archivo")
    read = rows.groupBy(year).agg(F.lit("leído").alias("estado"), F.count(F.lit(1)).alias("filas"))
    return read.unionByName(failed.select(year, F.col("reason").alias("estado"), F.lit(0).cast("bigint").alias("filas")))


@query(SQL_AGREEMENT_ROWS + """SELECT 'a' AS carpeta, count(*) FILTER (reasons = '') AS validos, 0 AS con_error, 0 AS avisos FROM checked
 UNION ALL SELECT 'b', 0, count(*) FILTER (reasons <> ''), 1 FROM checked""")
def same_name_counts(spark, folder):
    """Namesakes in two folders, one of valid rows and one of errors: each has its own counts, and one a warning."""
    place = scratch(spark, "counts")
    agreements = raw.raw_agreements(spark, folder)
    wrong = F.size("reasons") > 0
    ids = clean_payments(agreements, on_duplicate="count").rows.select(F.col("nro_acuerdo").alias("numero"), wrong.alias("mala"))
    marked = agreements.join(ids, agreements["nro_acuerdo"] == ids["numero"])
    for part, bad in (("a", False), ("b", True)):
        rows = marked.where(F.col("mala") == bad).select(*feeds.AGREEMENT_COLUMNS)
        write_whole(rows, f"{place}/{part}", f"{feeds.AGREEMENT_PREFIX} 0.txt")
    result = payments_folder(spark, [f"{place}/a", f"{place}/b"], on_duplicate="count")
    none = F.lit(0).cast("bigint")
    warned = files_without_valid_rows(result).select(
        F.lit("b").alias("carpeta"), none.alias("validos"), none.alias("con_error"), F.lit(1).alias("avisos")
    )
    counts = file_counts(result).select(
        F.when(F.col("validos") > 0, "a").otherwise("b").alias("carpeta"), "validos", "con_error", F.lit(0).alias("avisos")
    )
    both = counts.unionByName(warned).groupBy("carpeta")
    return both.agg(F.sum("validos").alias("validos"), F.sum("con_error").alias("con_error"), F.sum("avisos").cast("int").alias("avisos"))


@query(SQL_AGREEMENT_ROWS + """SELECT id_registro, 2 * count(*) AS n FROM checked WHERE reasons = '' GROUP BY id_registro""")
def same_name_folders(spark, folder):
    """The same files in two folders: none fails for the ids that the other has too."""
    place = scratch(spark, "namesakes")
    for part in ("a", "b"):
        write_text(raw.raw_agreements(spark, folder).drop("archivo_origen"), f"{place}/{part}", feeds.AGREEMENT_PREFIX)
    valid = payments_folder(spark, [f"{place}/a", f"{place}/b"]).valid
    return valid.groupBy("id_registro").agg(F.count(F.lit(1)).alias("n"))


@query(SQL_AGREEMENT_ROWS + """SELECT * EXCLUDE (reasons, archivo_origen) FROM checked WHERE reasons = ''""")
def stream_file_drop(spark, folder):
    """Half of the files are dropped and loaded, then the rest, then nothing new."""
    place, target, state = (scratch(spark, n) for n in ("drop", "streamed", "state"))
    agreements = raw.raw_agreements(spark, folder)
    early = agreements["archivo_origen"] <= "A_1997"
    for prefix, part in (("a", early), ("b", ~early)):
        write_text(agreements.where(part).drop("archivo_origen"), place, f"{feeds.AGREEMENT_PREFIX} {prefix}")
        load_dropped(spark, "pagos", place, target, state).awaitTermination()
    load_dropped(spark, "pagos", place, target, state).awaitTermination()
    held = read_target(spark, target, storage_schema(feeds.PAYMENT_TARGET))
    return comparable(held.drop("periodo", "lote", "archivo_origen"), "fecha_pago")


LATIN = r"\A[\x00-\xFF]*\z"


@query("""SELECT doc_id, text AS contenido, CASE WHEN regexp_full_match(text, '(?s)[\\x00-\\x{FF}]*')
  AND NOT regexp_full_match(text, '(?s)[\\x00-\\x7F]*') THEN 'ISO-8859-1' ELSE 'utf-8' END AS encoding FROM documents""")
def encoding_detect(spark, folder):
    """Every document as bytes: Latin-1 where that can hold it, else UTF-8."""
    latin = F.col("text").rlike(LATIN)
    narrow = F.encode(F.when(latin, F.col("text")), "ISO-8859-1")
    content = F.coalesce(narrow, F.encode("text", "UTF-8")).alias("content")
    return decode_content(table(spark, folder, "documents").select("doc_id", content))


# --- workbooks ----------------------------------------------------------------------

BOOK_ROWS = 2_000  # rows of one sheet of one workbook
SHEETS = {"clientes": ["clave", "nombre", "nacion", "segmento"], "proveedores": ["clave", "nombre", "nacion"]}
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def write_book(sheets: dict[str, list[list]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        entries, links = [], []
        for n, (name, rows) in enumerate(sheets.items(), 1):
            entries.append(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>')
            links.append(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>')
            lines = []
            for row in rows:
                cells = [
                    f"<c><v>{v}</v></c>" if isinstance(v, int)
                    else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
                    for v in row
                ]
                lines.append(f"<row>{''.join(cells)}</row>")
            body = f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
            book.writestr(f"xl/worksheets/sheet{n}.xml", body)
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{"".join(entries)}</sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{PACKAGE}">{"".join(links)}</Relationships>',
        )
    return out.getvalue()


def books(spark, folder) -> DataFrame:
    """Customers and suppliers as two sheets per workbook, at most BOOK_ROWS rows each."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        sheets = {}
        for name, columns in SHEETS.items():
            rows = pdf[pdf["hoja"] == name].sort_values("clave")[columns]
            sheets[name] = [columns, *rows.astype(object).values.tolist()]
        return pd.DataFrame({"archivo_origen": [f"libro_{pdf['libro'].iloc[0]}.xlsx"], "content": [write_book(sheets)]})

    customers = table(spark, folder, "customer").select(
        F.lit("clientes").alias("hoja"), F.col("c_custkey").alias("clave"), F.col("c_name").alias("nombre"),
        F.col("c_nationkey").alias("nacion"), F.col("c_mktsegment").alias("segmento"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.lit("proveedores").alias("hoja"), F.col("s_suppkey").alias("clave"), F.col("s_name").alias("nombre"),
        F.col("s_nationkey").alias("nacion"), F.lit("").alias("segmento"),
    )
    number = F.floor(F.col("clave") / BOOK_ROWS).alias("libro")
    rows = customers.unionByName(suppliers).select("*", number)
    return rows.groupBy("libro").applyInPandas(build, "archivo_origen string, content binary")


def stored_books(spark, folder) -> str:
    """The workbooks as files, each written by the task that made it."""
    place = scratch(spark, "libros")

    def store(batches):
        target, path = pyarrow.fs.FileSystem.from_uri(place)
        target.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch["archivo_origen"], batch["content"]):
                with target.open_output_stream(f"{path}/{name}") as out:
                    out.write(content)
            yield batch[["archivo_origen"]]

    books(spark, folder).mapInPandas(store, "archivo_origen string").write.format("noop").mode("overwrite").save()
    return place


@query(f"""SELECT concat('libro_', c_custkey // {BOOK_ROWS}, '.xlsx') AS archivo_origen, 'clientes' AS sheet_name,
  CAST(c_custkey AS VARCHAR) AS clave, c_name AS nombre, CAST(c_nationkey AS VARCHAR) AS nacion, c_mktsegment AS segmento
 FROM customer UNION ALL SELECT concat('libro_', s_suppkey // {BOOK_ROWS}, '.xlsx'), 'proveedores',
  CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), NULL FROM supplier""")
def workbook_scan(spark, folder):
    rows = scan_workbooks(spark, stored_books(spark, folder)).where("row_no > 0")
    cell = lambda c: F.try_element_at("cells", F.lit(c)).alias(c)
    return rows.select("archivo_origen", "sheet_name", *[cell(c) for c in SHEETS["clientes"]])


@query(f"""SELECT concat('libro_', c_custkey // {BOOK_ROWS}, '.xlsx') AS archivo_origen, c_name AS nombre FROM customer""")
def workbook_first_sheet(spark, folder):
    rows = scan_workbooks(spark, stored_books(spark, folder)).where("sheet_no = 0 AND row_no > 0")
    return rows.select("archivo_origen", F.col("cells")["nombre"].alias("nombre"))


@query(f"""SELECT concat('libro_', c_custkey // {BOOK_ROWS}, '.xlsx') AS archivo_origen, 'clientes' AS sheet_name,
  'filas' AS code, CAST(count(*) AS VARCHAR) AS detail FROM customer GROUP BY ALL
 UNION ALL SELECT DISTINCT concat('libro_', c_custkey // {BOOK_ROWS}, '.xlsx'), 'proveedores', 'columnas_faltantes', 'segmento'
 FROM customer""")
def required_columns_gate(spark, folder):
    """Sheets with every required column give rows, the others a warning."""
    table_rows, warnings, _ = split_sheets(parse_workbooks(books(spark, folder)), SHEETS["clientes"])
    counted = table_rows.groupBy("archivo_origen", "sheet_name").agg(
        F.lit("filas").alias("code"), F.count(F.lit(1)).cast("string").alias("detail")
    )
    return counted.unionByName(warnings.withColumnRenamed("source_file", "archivo_origen"))
