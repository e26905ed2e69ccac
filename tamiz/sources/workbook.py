"""Folders of ``.xlsx`` workbooks: files are spread over tasks, sheets become rows.

A workbook is a zip file and cannot be split, so the unit of work is one file; the
format itself bounds a sheet to about a million rows.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.functions.text import file_name
from tamiz.session import materialize

WORKBOOKS = "*.[xX][lL][sS][xX]"
HEADER_ROW = 0
BATCH = 2_000

ROW_SCHEMA = (
    "archivo_origen string, sheet_no int, sheet_name string, row_no bigint, "
    "cells map<string,string>, failure string"
)

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def read_workbooks(
    spark: SparkSession, path: str | list[str], sheet: int | None = None, by_path: bool = False
) -> DataFrame:
    """Rows of every sheet (or of sheet number ``sheet``) of every workbook.

    ``archivo_origen`` is the file's name, or its path with ``by_path``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", WORKBOOKS).load(path)
    name = F.col("_metadata.file_path") if by_path else file_name(F.col("_metadata.file_name"))
    named = files.select(name.alias("archivo_origen"), "content")
    return parse_workbooks(named, sheet)


def parse_workbooks(files: DataFrame, sheet: int | None = None) -> DataFrame:
    """(archivo_origen, content) to one row per sheet row.

    ``row_no`` 0 is the header, with null cells; a file that cannot be read gives
    one row with ``failure`` set, and the other files go on.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["archivo_origen"], batch["content"]):
                yield from _batches(name, content, sheet)

    return files.select("archivo_origen", "content").mapInPandas(parse, ROW_SCHEMA)


def split_sheets(
    rows: DataFrame, required: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strict column gate per sheet: (rows of good sheets, warnings, failed files).

    Every row carries its sheet's header, so the gate needs no shuffle. A file
    without a single good sheet fails.
    """
    wanted = F.array(*[F.lit(c) for c in required])
    absent = F.array_except(wanted, F.map_keys("cells"))
    headers = rows.where((F.col("row_no") == HEADER_ROW) & F.col("failure").isNull())
    # Nothing of a file that broke off is used, not even its good sheets.
    unreadable = materialize(
        rows.where("failure IS NOT NULL").groupBy("archivo_origen").agg(F.min("failure").alias("reason"))
    )
    whole = rows.join(unreadable.select("archivo_origen"), "archivo_origen", "left_anti")
    good = whole.where((F.col("row_no") > HEADER_ROW) & (F.size(absent) == 0))
    table = good.select(
        *[F.col("cells")[c].alias(c) for c in required],
        "archivo_origen",
        "sheet_name",
        (F.shiftleft(F.col("sheet_no").cast("bigint"), 32) + F.col("row_no")).alias("posicion"),
    )
    warnings = headers.where(F.size(absent) > 0).select(
        F.col("archivo_origen").alias("source_file"),
        "sheet_name",
        F.lit("columnas_faltantes").alias("code"),
        F.concat_ws(", ", absent).alias("detail"),
    )
    no_sheet = (
        headers.groupBy("archivo_origen")
        .agg(F.max(F.size(absent) == 0).alias("any_good"))
        .where("NOT any_good")
        .select("archivo_origen", F.lit("ninguna hoja válida").alias("reason"))
    )
    return table, warnings, no_sheet.unionByName(unreadable)


# --- one workbook, inside a task ----------------------------------------------------


def _batches(name: str, content: bytes, sheet: int | None) -> Iterator[pd.DataFrame]:
    columns = ["archivo_origen", "sheet_no", "sheet_name", "row_no", "cells", "failure"]

    def rows() -> Iterator[tuple]:
        try:
            for row in sheet_rows(io.BytesIO(content), lambda number, title: sheet is None or number == sheet):
                yield (name, *row, None)
        except Exception as e:  # damaged and encrypted books fail in many ways, each for itself
            yield name, None, None, HEADER_ROW, {}, f"{type(e).__name__}: {e}"

    for some in batches_of(rows()):
        yield pd.DataFrame(some, columns=columns)


def batches_of(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """At most ``BATCH`` rows at a time."""
    while some := list(islice(rows, BATCH)):
        yield some


def sheet_rows(file: BinaryIO, wanted: Callable[[int, str], bool]) -> Iterator[tuple]:
    """(number, name, row, cells) of the sheets whose number and name are ``wanted``."""
    with zipfile.ZipFile(file) as book:
        strings = _shared_strings(book)
        date_styles, epoch = _styles(book)
        for number, (title, member) in enumerate(sheets_of(book)):
            if not wanted(number, title):
                continue
            with book.open(member) as xml:
                rows = _sheet_rows(xml, strings, date_styles, epoch)
                top, cells = next(rows, (None, None))
                if top is None:
                    continue
                header = _header(cells)
                yield number, title, HEADER_ROW, dict.fromkeys(header)
                last = top
                for at, cells in rows:
                    if all(v is None for v in cells.values()):
                        continue
                    # Empty rows count between others, not after the last one.
                    for blank in range(last + 1, at):
                        yield number, title, blank - top, dict.fromkeys(header)
                    yield number, title, at - top, {c: cells.get(i) for i, c in enumerate(header)}
                    last = at


def _header(cells: dict[int, str | None]) -> list[str]:
    names: list[str] = []
    for i in range(max(cells, default=-1) + 1):
        name = cells.get(i) or f"Unnamed: {i}"
        same = sum(n == name or n.startswith(f"{name}.") for n in names)
        names.append(f"{name}.{same}" if same else name)
    return names


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and member of every sheet, in the workbook's order."""
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in relations}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    found = []
    for s in root.iter(f"{_MAIN}sheet"):
        target = targets[s.get(_RELATION)]
        found.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_text(item) for item in root.iter(f"{_MAIN}si")]


def _text(item: ElementTree.Element) -> str:
    """Plain or rich text; phonetic hints are not part of it."""
    direct = [t.text or "" for t in item.findall(f"{_MAIN}t")]
    runs = [t.text or "" for r in item.findall(f"{_MAIN}r") for t in r.findall(f"{_MAIN}t")]
    return "".join(direct + runs)


def _styles(book: zipfile.ZipFile) -> tuple[set[int], dt.datetime]:
    """Cell styles that show dates, and day zero of the workbook."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    properties = root.find(f"{_MAIN}workbookPr")
    late = properties is not None and properties.get("date1904") in ("1", "true")
    epoch = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
    if "xl/styles.xml" not in book.namelist():
        return set(), epoch
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(_DATE_FORMATS)
    for f in styles.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.IGNORECASE):
            dated.add(int(f.get("numFmtId")))
    cells = styles.find(f"{_MAIN}cellXfs")
    formats = [] if cells is None else [int(x.get("numFmtId", 0)) for x in cells]
    return {i for i, f in enumerate(formats) if f in dated}, epoch


def _sheet_rows(xml, strings, date_styles, epoch) -> Iterator[tuple[int, dict[int, str | None]]]:
    """Row number and cells by column index; parsed as a stream, one row in memory."""
    data, at = None, 0
    for event, element in ElementTree.iterparse(xml, events=("start", "end")):
        if event == "start":
            data = element if element.tag == f"{_MAIN}sheetData" else data
        elif element.tag == f"{_MAIN}row":
            at = int(element.get("r", at + 1))
            cells, column = {}, -1
            for c in element.findall(f"{_MAIN}c"):
                column = _column(c.get("r"), column + 1)
                cells[column] = _value(c, strings, date_styles, epoch)
            yield at, cells
            data.clear()


def _column(reference: str | None, default: int) -> int:
    if not reference:
        return default
    index = 0
    for letter in reference.rstrip("0123456789"):
        index = index * 26 + ord(letter) - 64
    return index - 1


def _value(c: ElementTree.Element, strings, date_styles, epoch) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        inline = c.find(f"{_MAIN}is")
        return None if inline is None else _text(inline)
    raw = c.findtext(f"{_MAIN}v")
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "d":
        return raw.replace("T", " ")
    if kind != "n":
        return raw
    if int(c.get("s", 0)) in date_styles:
        moment = epoch + dt.timedelta(milliseconds=round(float(raw) * 86_400_000))
        return moment.isoformat(sep=" ", timespec="seconds" if not moment.microsecond else "microseconds")
    number = float(raw)
    return str(int(number)) if number.is_integer() else repr(number)
