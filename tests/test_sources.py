"""Text folders, workbooks, encodings and database options."""

import csv
import datetime as dt
import uuid
from collections import Counter

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tamiz import feeds
from tamiz.functions.text import READER_NULLS, clean_nulls
from tamiz.plans.folders import (
    concatenated_folder, consolidated_folder, contacts_folder, file_counts, files_without_valid_rows, messages_folder,
    payments_folder,
)
from tamiz.plans.payments import CONSOLIDATED
from tamiz.sinks.database import write_options
from tamiz.sources.database import connection_options, key_query, month_predicates
from tamiz.sources.files import read_files
from tamiz.sources.lines import read_lines
from tamiz.sources.text import TEXT_FILES, list_files, named_otherwise, read_headers, read_text, scan_text
from tamiz.sources.workbook import read_workbooks, split_sheets
from tamiz.sources.workbook_source import scan_workbooks
from tests.workbooks import workbook

AP_HEADER = "\t".join(feeds.AGREEMENT_COLUMNS)


def write(path, *lines, encoding="ISO-8859-1"):
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))


def agreement(number, valor="10", name="ANA"):
    return "\t".join([number, "1010", name, "PEÑA", valor, "2025-01-02", "1"])


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "Ap pagados 02 ñ+.txt", AP_HEADER, agreement("1"), "", agreement("2", valor='"5"'), "\t\t\t\t\t\t", " \t")
    # Other column order, an extra column, one column missing.
    write(tmp_path / "Ap pagados b.TXT", "extra\tvalor\tnombres\tapellidos\tfecha_liquida\tid_usuario\tnro_acuerdo",
          "x\t7\tLUIS\tGIL\t2025-01-03\t99\t3", "y\tNA\tLUIS\tGIL\t2025-01-03\t99\t4")
    write(tmp_path / "Ap pagados dup.txt", AP_HEADER, agreement("5"), agreement("5"))
    write(tmp_path / "Ap pagados long.txt", AP_HEADER, agreement("6"), agreement("7") + "\tmore")
    (tmp_path / "Ap pagados vacio.txt").write_bytes(b"")
    write(tmp_path / "Comparendos pagados 1.txt", "\t".join(feeds.TICKET_COLUMNS),
          "C-1\t9\t2025-01-02 08:15:00\t12000.75\t2020\tEVA\tSOL\tR-1\t98.90",
          "\t9\t2025-01-03\t500\t2020\tEVA\tSOL\tR-2\t")
    write(tmp_path / "Comparendos pagados malos.txt", "\t".join(feeds.TICKET_COLUMNS),
          "C-1\t9\tayer\t1\t2020\tEVA\tSOL\tR-1\t1")
    write(tmp_path / "otro.txt", "a\tb", "1\t2")
    write(tmp_path / "Ap pagados.csv", AP_HEADER, agreement("9"))
    return tmp_path


def test_folder_of_payments(spark, folder):
    result = payments_folder(spark, str(folder))
    got = {r.identificador_infraccion: r for r in result.valid.collect()}
    assert set(got) == {"1", "2", "3", "C-1", "R-2"}
    assert got["1"].archivo_origen == "Ap pagados 02 ñ+.txt" and got["1"].nombre_usuario == "ANA PEÑA"
    assert got["2"].valor == 5 and got["3"].documento == "99" and got["R-2"].valor == 500
    assert dict(map(tuple, result.failed_files.collect())) == {
        "otro.txt": "tipo de archivo no reconocido",
        "Ap pagados dup.txt": "ids duplicados",
        "Ap pagados long.txt": "fila con más campos que el encabezado",
        "Ap pagados vacio.txt": "archivo sin encabezado",
    }
    assert [(r.identificador_infraccion, r.reasons) for r in result.errors.where("archivo_origen like 'Ap%' and documento is not null").collect()] == [("4", ["valor faltante"])]
    blank = result.errors.where("documento is null").collect()
    assert [(r.archivo_origen, len(r.reasons)) for r in blank] == [("Ap pagados 02 ñ+.txt", 5)] * 2
    assert {(r.source_file, r.detail) for r in result.warnings.collect()} == {("Ap pagados b.TXT", "consecutivo_cuota")}
    assert [r.source_file for r in files_without_valid_rows(result).collect()] == ["Comparendos pagados malos.txt"]


def test_listing_is_flat_and_case_insensitive(spark, folder):
    names = {r.source_file for r in list_files(spark, str(folder)).collect()}
    assert "Ap pagados b.TXT" in names and "Ap pagados.csv" not in names and len(names) == 7


def test_headers_of_split_files(spark, tmp_path):
    write(tmp_path / "Ap pagados 1.txt", "", AP_HEADER, *[agreement(str(i)) for i in range(3000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        scan = scan_text(spark, str(tmp_path), feeds.AGREEMENT_COLUMNS)
        assert scan.rows.rdd.getNumPartitions() > 5
        assert scan.rows.select("nro_acuerdo").distinct().count() == 3000
        assert read_headers(spark, str(tmp_path)).first().header == feeds.AGREEMENT_COLUMNS
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_whole_folder_as_one_table(spark, folder):
    table, failed = concatenated_folder(spark, str(folder))
    assert [tuple(r) for r in failed.collect()] == [("Ap pagados long.txt", "fila con más campos que el encabezado")]
    assert table.where("Fuente_Archivo LIKE '%long%'").isEmpty()
    assert table.columns[-1] == "Fuente_Archivo" and {"extra", "a", "b", "nro_recibo"} <= set(table.columns)
    assert table.where("a = '1'").first().Fuente_Archivo == "otro.txt"
    assert table.where("extra = 'x'").first().id_usuario == 99
    texts, failed = consolidated_folder(spark, str(folder))
    assert [r[0] for r in failed.collect()] == ["Ap pagados long.txt"]
    assert texts.columns == CONSOLIDATED
    found = {(r.nro_comparendo, r.valor, r.archivo_origen) for r in texts.where("nro_acuerdo is null").collect()}
    assert ("C-1", "12099", "Comparendos pagados 1.txt") in found and (None, None, "otro.txt") in found
    shapes = {r.archivo_origen: (r.filas, r.columnas) for r in scan_text(spark, str(folder)).shapes().collect()}
    assert shapes["Ap pagados b.TXT"] == (2, 7) and shapes["otro.txt"] == (1, 2)


def test_other_families_are_not_read(spark, folder):
    families = ("Ap pagados", "Comparendos pagados")
    headers = read_headers(spark, str(folder), outside=families)
    assert [r.archivo_origen for r in headers.collect()] == ["otro.txt"]
    lines = read_lines(spark, str(folder), TEXT_FILES, "\t", named_otherwise(families))
    assert [r.value for r in lines.collect()] == [b"a\tb", b"1\t2"]


def test_same_name_in_two_folders(spark, tmp_path):
    for name, header in (("a", "x\ty"), ("b", "y\tx")):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "f.txt", header, "1\t2")
    scan = scan_text(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ["x", "y"])
    assert sorted(tuple(r)[:2] for r in scan.rows.collect()) == [("1", "2"), ("2", "1")]


def test_quoted_cells(spark, tmp_path):
    write(tmp_path / "a.txt", "x\ty", 'p\t"q ""r"" s"', '"t\tu"\tv')
    got = read_text(spark, str(tmp_path), ["x", "y"]).select("x", "y").collect()
    assert sorted(map(tuple, got)) == [("p", 'q "r" s'), ("t\tu", "v")]
    write(tmp_path / "a.txt", "x\ty", '"two\nlines"\tv')
    scan = scan_text(spark, str(tmp_path), ["y", "x", "z"], multiline=True)
    assert [tuple(r)[:3] for r in scan.rows.collect()] == [("v", "two\nlines", None)]
    assert scan.warnings.first().detail == "z"


def test_encodings(spark, tmp_path):
    write(tmp_path / "l.txt", "peña", encoding="ISO-8859-1")
    write(tmp_path / "u.txt", "peña", encoding="utf-8")
    got = {r.nombre_archivo: (r.contenido, r.encoding) for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"l.txt": ("peña\n", "ISO-8859-1"), "u.txt": ("peña\n", "utf-8")}


STYLES = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/></cellXfs></styleSheet>'
)


def contact_row(**change):
    row = {"Número documento": 555, "Teléfono": 3001234567, "Funcionario": "agente1",
           "Fecha gestión": (45293.127835648147, 1), "Obligación": "OB-1", "Resultado": "CONTACTO"} | change
    return [row.get(c) for c in feeds.CONTACT_COLUMNS]


def test_contact_workbooks(spark, tmp_path):
    sheets = {
        "enero": [feeds.CONTACT_COLUMNS, contact_row(Nombre="primera"), contact_row(Nombre="segunda")],
        "sin columna": [feeds.CONTACT_COLUMNS[:-1], contact_row()[:-1]],
    }
    (tmp_path / "a ñ.xlsx").write_bytes(workbook(sheets, STYLES))
    (tmp_path / "mala.XLSX").write_bytes(b"no zip")
    (tmp_path / "vacia.xlsx").write_bytes(workbook({"h": [["x"]]}))
    result = contacts_folder(spark, str(tmp_path))
    got = {r.nombre_usuario: r.id_registro for r in result.valid.collect()}
    assert got == {
        "primera": "70a9c4e80020e8ada51d57a4d07bf34c4ddc6367cd5689db495e3a562e995ac5",
        "segunda": "9e47ae63ab3a16db5b3f6d008245e6d32d769e861131ecf65bc3a68a089725bf",
    }
    assert {(r.source_file, r.sheet_name) for r in result.warnings.collect()} == {("a ñ.xlsx", "sin columna"), ("vacia.xlsx", "h")}
    failed = dict(map(tuple, result.failed_files.collect()))
    assert failed["vacia.xlsx"] == "ninguna hoja válida" and "BadZipFile" in failed["mala.XLSX"]


def test_message_workbook_and_first_sheet(spark, tmp_path):
    row = dict(zip(feeds.MESSAGE_COLUMNS, ["CC", 777, "ANA", (45293, 2), "OK", "hola", "BASE1", 3009876543, "C-9"]))
    sheets = {"uno": [feeds.MESSAGE_COLUMNS, list(row.values())], "dos": [["x"], ["1"], [None], [2.5], [None]]}
    (tmp_path / "m.xlsx").write_bytes(workbook(sheets, STYLES))
    got = messages_folder(spark, str(tmp_path)).valid.first()
    assert got.id_registro == "5138fac0ec61daff7fe99f01a3acc68ca15fd674fe395f20d3d10747f92c0aa8"
    first = read_workbooks(spark, str(tmp_path), sheet=0)
    assert {r.sheet_name for r in first.collect()} == {"uno"}
    second = read_workbooks(spark, str(tmp_path), sheet=1).where("row_no > 0").orderBy("row_no")
    assert [(r.row_no, r.cells["x"]) for r in second.collect()] == [(1, "1"), (2, None), (3, "2.5")]


def test_workbooks_as_a_source(spark, tmp_path):
    wide = [["x", "y"], *[[str(i), None if i % 3 else i] for i in range(4500)]]
    (tmp_path / "grande ñ.xlsx").write_bytes(workbook({"uno": wide, "dos": [["x"], ["2"]], "tres": [["x"]], "cuatro": []}))
    for i in range(5):
        (tmp_path / f"chico {i}.XLSX").write_bytes(workbook({"dos": [["x"], [str(i)]]}))
    (tmp_path / "mala.xlsx").write_bytes(b"no zip" * 4000)
    (tmp_path / "otro.txt").write_bytes(b"x")
    (tmp_path / "~$nada").mkdir()

    rows = scan_workbooks(spark, str(tmp_path), split_bytes=8192)
    same = read_workbooks(spark, str(tmp_path))
    key = lambda r: (r.archivo_origen, r.sheet_no, r.sheet_name, r.row_no, str(r.cells), r.failure)
    assert sorted(map(repr, map(key, rows.collect()))) == sorted(map(repr, map(key, same.collect())))
    # A task for each sheet of the large workbook, one for the broken file, few for the small ones.
    assert rows.rdd.getNumPartitions() == 4 + 1 + 1

    asked = rows.where("sheet_name = 'dos' AND row_no > 0")
    assert asked.rdd.getNumPartitions() == 1 + 1 + 1
    assert sorted(r.cells["x"] for r in asked.collect()) == ["0", "1", "2", "2", "3", "4"]
    assert rows.where("sheet_name IN ('uno', 'tres') AND sheet_no = 2").count() == 1
    assert rows.where("sheet_name = 'no hay'").collect() == []
    assert [r.archivo_origen for r in rows.where("failure IS NOT NULL").collect()] == ["mala.xlsx"]
    one = scan_workbooks(spark, str(tmp_path / "grande ñ.xlsx"))
    assert one.where("sheet_no = 0").count() == 4501 and one.rdd.getNumPartitions() == 1
    (tmp_path / "vacia").mkdir()
    assert scan_workbooks(spark, str(tmp_path / "vacia")).collect() == []


def test_a_workbook_broken_in_two_sheets_fails_once(spark, tmp_path):
    good = workbook({"a": [["x"], ["1"]], "b": [["x"], ["2"]], "c": [["x"], ["3"]]})
    cut = good.replace(b"PK\x03\x04", b"PK\x03\x05")
    (tmp_path / "rota.xlsx").write_bytes(cut)
    rows = scan_workbooks(spark, str(tmp_path), split_bytes=1)
    table, warnings, failed = split_sheets(rows, ["x"])
    assert table.count() == 0 and warnings.count() == 0
    assert [r.archivo_origen for r in failed.collect()] == ["rota.xlsx"]


def test_database_options(spark, monkeypatch):
    for field, value in dict(HOST="h", PORT="5432", USER="u", PASSWORD="p", NAME="n").items():
        monkeypatch.setenv(f"DB_{field}", value)
    options = connection_options(spark)
    assert options["url"] == "jdbc:postgresql://h:5432/n" and options["password"] == "p"
    monkeypatch.delenv("DB_PASSWORD")
    with pytest.raises(ValueError, match="password"):
        connection_options(spark)
    days = (dt.date(2024, 1, 15), dt.date(2024, 2, 1))
    assert key_query("pagos", date="fecha_pago", between=days) == (
        "(select id_registro from pagos where fecha_pago >= date '2024-01-15' and fecha_pago < date '2024-02-02') keys"
    )
    assert month_predicates("d", *days) == [
        "d >= date '2024-01-01' and d < date '2024-02-01'", "d >= date '2024-02-01' and d < date '2024-03-01'",
    ]
    assert write_options(options)["batchsize"] == "500"


def test_file_names_keep_plus_and_percent(spark, tmp_path):
    write(tmp_path / "a+b%20c ñ.txt", "x", "1")
    assert read_text(spark, str(tmp_path), ["x"]).first().archivo_origen == "a+b%20c ñ.txt"
    assert list_files(spark, str(tmp_path)).select(F.col("source_file")).first()[0] == "a+b%20c ñ.txt"


CELLS = st.sampled_from(["", "a", " b ", "NA", "null", 'q"r', "t\tu", '"', "ñ", "1.0", "  ", "x\\", '""', "'", "#c"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(CELLS, CELLS, CELLS), min_size=1, max_size=40))
@pytest.mark.parametrize("multiline", [False, True])
def test_text_is_read_like_a_dataframe_reader_does(spark, tmp_path, multiline, data):
    path = tmp_path / f"{uuid.uuid4().hex}.txt"
    if multiline:
        data = [(*row[:2], f"{row[2]}\nz") for row in data]
    with path.open("w", encoding="ISO-8859-1", newline="") as out:
        writer = csv.writer(out, delimiter="\t", lineterminator="\n")
        writer.writerows([("x", "y", "z"), *data])
    frame = pd.read_csv(path, sep="\t", dtype=str, encoding="ISO-8859-1")
    read = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
    # A row of nothing but blanks is a row of nulls here.
    want = Counter(row if any(v and v.strip() for v in row) else (None,) * 3 for row in read)
    scan = scan_text(spark, str(path), ["x", "y", "z"], glob="*.txt", multiline=multiline)
    cleaned = clean_nulls(scan.rows.drop("malformed"), READER_NULLS, skip=("archivo_origen",))
    got = [tuple(r)[:3] for r in cleaned.collect()]
    assert Counter(row if any(v and v.strip() for v in row) else (None,) * 3 for row in got) == want
    assert scan.rows.where("malformed").isEmpty()


PIECES = st.sampled_from(["a", '"', '""', "\t", "\n", "é", " ", 'b"', '"c"'])


def as_records(text):
    """What a character-by-character reader makes of a text: rows of cells, and whether a quote is left open."""
    rows, cells, cell, state = [], [], "", "start"
    for c in [*text, "\n"] if not text.endswith("\n") else text:
        if state == "quoted":
            state = "closing" if c == '"' else state
            cell += "" if c == '"' else c
        elif state == "closing" and c == '"':
            cell, state = cell + c, "quoted"
        elif c in "\t\n":
            cells, cell, state = [*cells, cell], "", "start"
            if c == "\n":
                rows, cells = [*rows, cells], []
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            cell, state = cell + c, "plain"
    return rows, state == "quoted"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=40, max_size=400))
def test_records_across_splits(spark, tmp_path, pieces):
    """Any text, in splits of a few bytes, gives the rows of a reader that reads it from start to end."""
    path = tmp_path / f"{uuid.uuid4().hex}.txt"
    text = "x\ty\n" + "".join(pieces) + "\n"
    path.write_bytes(text.encode("latin-1"))
    rows, left_open = as_records(text)
    want = Counter(tuple((c or None) for c in (r + [""])[:2]) for r in rows[1:] if any(c.strip(" \n") for c in r) or len(r) > 1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = scan_text(spark, str(path), ["x", "y"], glob="*.txt").rows
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 1 or len(text) < 70
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    blank = lambda row: tuple(None if v is None or not v.strip(" \n") else v for v in row)
    closed = Counter(blank((r.x, r.y)) for r in got if not (left_open and r.malformed and r.x is None))
    whole = Counter(map(blank, want.elements()))
    if left_open:
        assert any(r.malformed for r in got)
        assert not Counter(blank((r.x, r.y)) for r in got if not r.malformed) - whole
    else:
        assert closed == whole


def test_encodings_of_a_folder(spark, tmp_path):
    write(tmp_path / "l.txt", "año\tx", "peña\t1", encoding="ISO-8859-1")
    write(tmp_path / "u.txt", "año\tx", "peña\t2", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("\ufeffaño\tx\npeña\t3\n".encode())
    scan = scan_text(spark, str(tmp_path), ["año", "x"], encoding="auto")
    assert sorted(tuple(r)[:2] for r in scan.rows.collect()) == [("peña", "1"), ("peña", "2"), ("peña", "3")]
    assert {r.archivo_origen: r.encoding for r in scan.headers.collect()} == {"l.txt": "ISO-8859-1", "u.txt": "UTF-8", "b.txt": "UTF-8"}


def test_counts_of_namesakes(spark, tmp_path):
    for place, valor in (("a", "10"), ("b", "x")):
        (tmp_path / place).mkdir()
        write(tmp_path / place / "Ap pagados.txt", AP_HEADER, agreement("1", valor=valor))
    result = payments_folder(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(map(tuple, file_counts(result).collect())) == [("Ap pagados.txt", 0, 1), ("Ap pagados.txt", 1, 0)]
    assert [r.source_file for r in files_without_valid_rows(result).collect()] == ["Ap pagados.txt"]
