"""One file made by many tasks, and what a target's rows move as."""

from pyspark.sql import functions as F

from tamiz import feeds
from tamiz.plans.payments import clean_payments
from tamiz.queries import files
from tamiz.session import scratch
from tamiz.sinks import tables
from tamiz.sinks.one_file import join_files
from tamiz.sources.text import scan_text


def test_one_file_is_written_by_many_tasks(spark, monkeypatch):
    place, counted = scratch(spark, "one"), []

    def watched(spark, folders, path):
        system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in folders:
            found = system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))
            counted.append(len([s for s in found if s.getPath().getName().startswith("part-") and s.getLen()]))
        join_files(spark, folders, path)

    monkeypatch.setattr(files, "join_files", watched)
    rows = spark.range(0, 1000, 1, 5).select("id", F.concat(F.lit("Peña\t\""), F.col("id").cast("string")).alias("b c"))
    files.write_whole(rows.withColumn("nada", F.lit(None).cast("string")), place, "Todo 0.txt")
    files.write_whole_lines(spark, "id\tb", rows.select(F.concat_ws("\t", F.col("id").cast("string"), F.lit("ñ")).alias("value")), place, "Otro 0.txt")
    assert counted == [1, 5, 1, 5]
    scan = scan_text(spark, place, ["id", "b c", "b", "nada"])
    assert sorted(tuple(r) for r in scan.shapes().collect()) == [("Otro 0.txt", 1000, 2), ("Todo 0.txt", 1000, 3)]
    got = {(r["id"], r["b c"], r["b"], r["nada"]) for r in scan.rows.collect()}
    assert got == {(str(i), f'Peña\t"{i}', None, None) for i in range(1000)} | {(str(i), None, "ñ", None) for i in range(1000)}


def test_file_without_lines_has_its_header(spark):
    place = scratch(spark, "one")
    files.write_whole(spark.range(0), place, "Nada 0.txt")
    files.write_whole_lines(spark, "a\tb", f"{place}/_absent", place, "Falta 0.txt")
    got = {r["archivo_origen"]: r["columnas"] for r in scan_text(spark, place).shapes().collect()}
    assert got == {"Nada 0.txt": 1, "Falta 0.txt": 2}


def test_ids_move_as_bytes_and_stay_as_they_are(spark):
    ids = ["ab" * 32, "AB" * 32, "abc", "", "Zz", None, "00ff"]
    rows = spark.createDataFrame([(i, k, "2024-01") for k, i in enumerate(ids)], "id_registro string, n int, periodo string")
    dealt = tables._dealt(rows, "id_registro")
    assert dealt.columns == rows.columns
    assert {r["n"]: r["id_registro"] for r in dealt.collect()} == dict(enumerate(ids))
    many = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id_registro"), F.lit("2024-01").alias("periodo"))
    plan = tables._dealt(many, "id_registro")._jdf.queryExecution().optimizedPlan().toString()
    assert "_packed" in plan.split("RebalancePartitions")[1]
    # Any type of key, and rows without one, are dealt as they are.
    assert tables._dealt(rows.select("n", "periodo"), "id_registro").count() == len(ids)
    assert tables._dealt(rows, "n").count() == len(ids)


def test_targets_and_checked_rows_are_stored_small(spark, tmp_path):
    def sizes(path):
        return [f.name for f in path.rglob("part-*") if f.suffix == ".parquet"]

    rows = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("id_registro"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("fecha_pago"))
    tables.append_batch(rows, str(tmp_path / "target"), "fecha_pago", "1")
    found = sizes(tmp_path / "target" / next(p.name for p in (tmp_path / "target").iterdir() if p.name.startswith("entrega=")))
    assert found and all(".zstd." in name for name in found)
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    raw = spark.createDataFrame([("1", "2", "a", "b", "3.5", "2024-01-02", "1", "A_1")], [*feeds.AGREEMENT_COLUMNS, "archivo_origen"])
    stored = clean_payments(raw.toDF(*raw.columns)).rows
    assert any(".zstd." in name for name in stored.inputFiles())
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before
