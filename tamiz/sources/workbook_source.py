"""Workbooks as a data source: ``spark.read.format("workbooks").load(folder)``.

A workbook of more than ``splitBytes`` is read by one task for each sheet, smaller
ones share tasks of about that size. Files are opened at any offset, so a task reads
the directory of a workbook, its strings and styles and its own sheets, and no file is
ever held as one row. Rows go to Spark as Arrow batches.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tamiz.sources.workbook import HEADER_ROW, ROW_SCHEMA, batches_of, sheet_rows, sheets_of

FORMAT = "workbooks"
#: Bytes of workbooks that a task reads, unless one sheet is larger.
SPLIT_BYTES = 4 << 20

ARROW_SCHEMA = pa.schema(
    [
        ("archivo_origen", pa.string()),
        ("sheet_no", pa.int32()),
        ("sheet_name", pa.string()),
        ("row_no", pa.int64()),
        ("cells", pa.map_(pa.string(), pa.string())),
        ("failure", pa.string()),
    ]
)


def scan_workbooks(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of every sheet of every workbook of a folder, in the columns of ``ROW_SCHEMA``.

    Equality and ``IN`` on ``sheet_name`` and ``sheet_no`` reach the source: sheets
    not asked for are neither opened nor given a task. Row 0 of a sheet is its header,
    with null cells; a file that cannot be read gives a row with ``failure`` for each
    of its tasks, and the other files go on. A folder without workbooks gives no rows.
    """
    register(spark)
    return spark.read.format(FORMAT).option("splitBytes", split_bytes).load(path)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


@dataclass
class Books(InputPartition):
    """Workbooks that a task reads: each one's path and the number of its sheet, or None for all."""

    parts: list[tuple[str, int | None]]


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.names: set | None = None
        self.numbers: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if f.attribute == ("sheet_name",):
                    self.names = values if self.names is None else self.names & values
                elif f.attribute == ("sheet_no",):
                    self.numbers = values if self.numbers is None else self.numbers & values
            # Spark judges them once more: a broken file's row has no sheet.
            yield f

    def _wanted(self, number: int, title: str) -> bool:
        return (self.names is None or title in self.names) and (self.numbers is None or number in self.numbers)

    def partitions(self) -> list[Books]:
        store, place = pyarrow.fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(place)
        if found.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else store.get_file_info(pyarrow.fs.FileSelector(place))
        books = sorted(
            (f for f in files if f.is_file and f.extension.lower() == "xlsx" and f.base_name[0] not in "._"),
            key=lambda f: f.path,
        )
        tasks: list[Books] = []
        shared, size = [], 0
        for book in books:
            if book.size > self.split_bytes:
                tasks += [Books([part]) for part in self._sheets(store, book.path)]
                continue
            if shared and size + book.size > self.split_bytes:
                tasks.append(Books(shared))
                shared, size = [], 0
            shared.append((book.path, None))
            size += book.size
        return tasks + [Books(shared)] * bool(shared)

    def _sheets(self, store, path: str) -> list[tuple[str, int | None]]:
        try:
            with store.open_input_file(path) as file, zipfile.ZipFile(file) as book:
                return [(path, n) for n, (title, _) in enumerate(sheets_of(book)) if self._wanted(n, title)]
        except Exception:  # the task that reads it says what is wrong with it
            return [(path, None)]

    def read(self, partition: Books | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark calls a source without partitions
            return
        store, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        for path, only in partition.parts:
            wanted = self._wanted if only is None else lambda number, title, only=only: number == only
            for rows in batches_of(self._rows(store, path, wanted)):
                name = path.rpartition("/")[2]
                columns = zip(*[(name, *row[:3], list(row[3].items()), row[4]) for row in rows])
                arrays = [pa.array(c, f.type) for c, f in zip(columns, ARROW_SCHEMA)]
                yield pa.RecordBatch.from_arrays(arrays, schema=ARROW_SCHEMA)

    def _rows(self, store, path: str, wanted) -> Iterator[tuple]:
        try:
            with store.open_input_file(path) as file:
                for row in sheet_rows(file, wanted):
                    yield (*row, None)
        except Exception as e:  # damaged and encrypted books fail in many ways, each for itself
            yield None, None, HEADER_ROW, {}, f"{type(e).__name__}: {e}"
