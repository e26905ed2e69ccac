"""What a scan of a folder leaves on disk, and when it goes."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamiz import feeds
from tamiz.operators.duplicates import repeated_ids
from tamiz.plans import folders
from tamiz.plans.folders import payments_folder
from tamiz.queries import QUERIES, files
from tamiz.session import materialize, released, scratch
from tamiz.sources.lines import read_lines, records
from tamiz.sources.text import TEXT_FILES, named_otherwise

HEADER = "\t".join(feeds.TICKET_COLUMNS)


def ticket(number, moment="2025-01-02 08:15:00", more=""):
    return f"{number}\t9\t{moment}\t12000.75\t2020\tEVA\tSOL\tR-1\t98.90{more}"


@pytest.fixture
def sent(tmp_path):
    place = tmp_path / "sent"
    place.mkdir()
    for name, *lines in (
        (f"{feeds.TICKET_PREFIX} 1.txt", HEADER, ticket("C-1"), ticket("C-2", "ayer"), ticket('"C\n3"')),
        (f"{feeds.TICKET_PREFIX} dos.txt", HEADER, ticket("C-4"), ticket("C-4")),
        (f"{feeds.TICKET_PREFIX} más.txt", HEADER, ticket("C-5", more="\tx")),
        (f"{feeds.AGREEMENT_PREFIX} corto.txt", "nro_acuerdo\tvalor", "1\t2"),
        ("otro.txt", "a", "1"),
    ):
        (place / name).write_text("\n".join(lines) + "\n", encoding="latin-1")
    return place


@pytest.fixture
def tables(spark, tmp_path):
    day = lambda y: dt.date(y, 3, 4)
    for name, columns, rows in (
        ("orders", "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string",
         [(k, k % 3, 10.0 + k, day(1994 + k % 4), "1-URGENT") for k in range(1, 120)]),
        ("customer", "c_custkey long, c_name string, c_mktsegment string", [(k, f"c{k}", "AUTO") for k in range(3)]),
        ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
         "l_extendedprice double, l_tax double, l_shipdate date",
         [(k, k + 1, 7, (k - 1) % 6 + 1, 2.0, 10.0 + k, 0.04, day(1995 + k % 2)) for k in range(1, 120)]),
        ("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(1, "s", 1, 1.5)]),
    ):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/tables/{name}.parquet")
    return f"{tmp_path}/tables"


def held(spark):
    """Files that lie in the shared folder of this application."""
    place = Path(scratch(spark, "x").split("/area-")[0]).parent
    return {p for p in place.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for n in range(files.size()) if (name := files.apply(n).getName()).startswith("shuffle")}


def everything(result):
    tables = result.rows.drop("fecha_carga"), result.rejected.drop("fecha_carga"), result.failed_files, result.warnings
    return [sorted(map(repr, t.collect())) for t in tables]


def test_lines_are_gone_once_the_rows_are_stored(spark, sent):
    before = held(spark)
    result = payments_folder(spark, str(sent))
    left = held(spark) - before
    assert left and not [p for p in left if "area-" in str(p)]
    assert not [p for p in left if "value" in spark.read.parquet(str(p)).columns]
    # Rows that are not stored go on reading the lines, and are the same.
    unstored = payments_folder(spark, str(sent), stage=False)
    assert everything(result) == everything(unstored)
    assert sorted(map(tuple, result.failed_files.collect())) == [
        (f"{feeds.TICKET_PREFIX} dos.txt", "ids duplicados"),
        (f"{feeds.TICKET_PREFIX} más.txt", "fila con más campos que el encabezado"),
        ("otro.txt", "tipo de archivo no reconocido"),
    ]
    assert [r.source_file for r in result.warnings.collect()] == [f"{feeds.AGREEMENT_PREFIX} corto.txt"]


@pytest.mark.parametrize("options", [{"dates": "by_file", "on_duplicate": "quarantine"}, {"stage": False}])
def test_files_may_go_once_they_are_read(spark, sent, options):
    want, gone = everything(payments_folder(spark, str(sent), **options)), []

    def remove():
        for path in [p for p in sent.iterdir() if not p.name.startswith(".")]:
            path.unlink()
            gone.append(path.name)

    names = sorted(p.name for p in sent.iterdir())
    assert everything(payments_folder(spark, str(sent), once_read=remove, **options)) == want
    assert sorted(gone) == names


def test_rows_are_checked_without_the_files(spark, tables, monkeypatch):
    """The query's own folder is gone when the rows are checked, its lines when the result is there."""
    before, seen, clean = held(spark), [], folders.clean_payments

    def watched(*args, **options):
        seen.append(held(spark) - before)
        return clean(*args, **options)

    monkeypatch.setattr(folders, "clean_payments", watched)
    families = QUERIES["scan_folder_routed"](spark, tables).groupBy("familia").count()
    # One line of 1996 comes twice, so that year's file fails: the odd keys.
    assert {r.familia: r["count"] for r in families.collect()} == {"Ap": 119, "Co": 59}
    assert {p.suffix for p in seen[0]} == {".parquet"} and [p for p in seen[0] if "area-" in str(p)]
    assert not [p for p in held(spark) - before if "area-" in str(p) or p.suffix.lower() == ".txt"]


def test_lines_are_stored_small(spark, sent):
    lines = read_lines(spark, str(sent), TEXT_FILES, "\t", named_otherwise(()))
    before = held(spark)
    records(lines).collect()
    stored = [Path(name).name for name in lines.inputFiles()] + [p.name for p in held(spark) - before]
    assert len(stored) > len(lines.inputFiles()) and all(".zstd." in name for name in stored)


def test_shuffled_ids_are_gone_when_the_repeated_are_known(spark):
    before = shuffled(spark)
    ids = spark.range(0, 2000, 1, 4).select(F.sha2((F.col("id") % 1990).cast("string"), 256).alias("id"))
    found = repeated_ids(ids, ["id"])
    assert not shuffled(spark) - before
    assert sorted(r.n for r in found.collect()) == [2] * 10


def test_shuffled_agreements_are_gone_when_written(spark, tables, monkeypatch):
    left, write = [], files.write_text

    def watched(df, folder, prefix, *rest):
        if prefix == feeds.AGREEMENT_PREFIX:
            df = df.repartition(3)
        write(df, folder, prefix, *rest)
        left.append(shuffled(spark) - before)

    monkeypatch.setattr(files, "write_text", watched)
    before = shuffled(spark)
    files.write_payment_folder(spark, tables)
    assert len(left) == 3 and not left[0]


def test_what_lasts_of_a_released_block(spark):
    with released(spark) as lasting:
        gone = scratch(spark, "gone")
        spark.range(3).write.parquet(gone)
        with lasting():
            kept = materialize(spark.range(4))
        with released(spark) as inner, inner():
            goes = materialize(spark.range(5))
        assert goes.count() == 5 and Path(scratch(spark, "x")).parent == Path(gone).parent
    assert kept.count() == 4 and not Path(gone).exists() and not Path(goes.inputFiles()[0].removeprefix("file://")).exists()
    # An error within it deletes all the same.
    with pytest.raises(ZeroDivisionError), released(spark):
        with released(spark):
            lost = materialize(spark.range(2)).inputFiles()[0].removeprefix("file://")
            assert Path(lost).exists()
            1 / 0
    assert not Path(lost).exists()
