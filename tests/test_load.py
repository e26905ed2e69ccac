"""Targets, incremental loads, reports and the file stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamiz import feeds
from tamiz.operators.incremental import existing_ids, increment, new_rows, observed
from tamiz.operators.schema import MissingColumns
from tamiz.plans.folders import payments_folder
from tamiz.plans.load import fit_target, load_batch, storage_schema
from tamiz.plans.messages import clean_messages
from tamiz.plans.payments import clean_payments
from tamiz.sinks.reports import report_name, sample_errors
from tamiz.sinks.buckets import held_ids, index_ids
from tamiz.sinks.manifest import Entry, Manifest
from tamiz.sinks.tables import (
    append_batch, compact, create_table, load_history, read_target, table_columns, unfit_rows,
)
from tamiz.streaming.file_drop import load_dropped
from tests.test_feeds import AP, CONTACT, MESSAGE, contacts, payments, rows
from tests.test_sources import AP_HEADER, agreement, write
from tests.workbooks import workbook

SCHEMA = storage_schema(feeds.PAYMENT_TARGET)


def test_second_load_adds_nothing(spark, tmp_path):
    target, report = str(tmp_path / "pagos"), str(tmp_path / "errores")
    result = payments(spark, [AP, AP | dict(valor="7", fecha_liquida="2025-03-01"), AP | dict(valor="x")])
    first = load_batch(result, "pagos", target, "b1", report)
    assert first.metrics == dict(
        validos=2, con_error=1, unicos=2, existentes=0, nuevos=2, ultima_fecha=dt.datetime(2025, 3, 1))
    again = load_batch(result, "pagos", target, "b1")
    assert again.metrics["nuevos"] == 2  # the same batch replaces itself
    other = load_batch(result, "pagos", target, "b2")
    assert (other.metrics["existentes"], other.metrics["nuevos"]) == (2, 0)
    assert read_target(spark, target, SCHEMA).count() == 2
    text = spark.read.option("header", True).csv(report).first()
    assert text.reasons == "valor faltante" and text.documento == "1010"


def test_created_table_shows_the_rows_of_its_loads(spark, tmp_path):
    target, name = str(tmp_path / "pagos"), "pagos_mostrados"
    create_table(spark, name, feeds.PAYMENT_TARGET, target)
    try:
        result = payments(spark, [AP, AP | dict(valor="7", fecha_liquida="2025-03-01")])
        for _ in range(2):  # a load that is run again shows its rows once
            load_batch(result, "pagos", target, "d'1", name=name)
            assert spark.table(name).count() == 2
        load_batch(payments(spark, [AP | dict(valor="9")]), "pagos", target, "b2", name=name)
        assert spark.table(name).count() == 3
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_lookup_reads_only_the_months_of_the_batch(spark, tmp_path):
    target = str(tmp_path / "pagos")
    days = ["2025-01-02", "2024-06-01", "1900-01-01"]
    load_batch(payments(spark, [AP | dict(fecha_liquida=d) for d in days]), "pagos", target, "b1")
    rows = read_target(spark, target, SCHEMA, {"2025-01", "1900-01"}).select("id_registro")
    assert {f.split("periodo=")[1][:7] for f in rows.inputFiles()} == {"2025-01", "1900-01"}
    assert "ReadSchema: struct<id_registro:string>" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 2


def test_lookup_opens_only_folders_that_may_hold_an_id(spark, tmp_path):
    target = str(tmp_path / "pagos")
    for n in range(6):
        load_batch(payments(spark, [AP | dict(valor=str(n + 1), id_usuario=str(k)) for k in range(5)]), "pagos", target, f"b{n}")
    held = read_target(spark, target, SCHEMA, batch="b3").select("id_registro").limit(2)
    found = read_target(spark, target, SCHEMA, {"2025-01"}, ids=held)
    assert len({f.split("entrega=")[1][:32] for f in found.inputFiles()}) == 1 and found.count() == 5
    other = spark.createDataFrame([("nothing",)], "id_registro string")
    assert read_target(spark, target, SCHEMA, {"2025-01"}, ids=other).inputFiles() == []


def test_a_batch_replaces_all_it_had(spark, tmp_path):
    target, name = str(tmp_path / "pagos"), "pagos_reemplazados"
    create_table(spark, name, feeds.PAYMENT_TARGET, target)
    try:
        def load(batch, *days):
            rows = [AP | dict(fecha_liquida=d) for d in days] or [AP | dict(valor="x")]
            load_batch(payments(spark, rows), "pagos", target, batch, name=name)
            return sorted(r.fecha_pago.isoformat()[:10] for r in spark.table(name).collect())

        assert load("b1", "2025-01-02", "2025-02-02") == ["2025-01-02", "2025-02-02"]
        assert load("b2", "2025-03-02") == ["2025-01-02", "2025-02-02", "2025-03-02"]
        assert load("b1", "2025-02-02") == ["2025-02-02", "2025-03-02"]
        assert load("b1") == ["2025-03-02"]
        assert read_target(spark, target, SCHEMA).count() == 1
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_a_load_that_breaks_off_shows_nothing(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "pagos")
    load_batch(payments(spark, [AP]), "pagos", target, "b1")

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Manifest, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        load_batch(payments(spark, [AP | dict(valor="7")]), "pagos", target, "b2")
    monkeypatch.undo()
    assert len([p for p in (tmp_path / "pagos").iterdir() if p.name.startswith("entrega=")]) == 2
    assert read_target(spark, target, SCHEMA).count() == 1
    load_batch(payments(spark, [AP | dict(valor="7")]), "pagos", target, "b2")
    Manifest(spark, target).clean(keep=1)
    assert len([p for p in (tmp_path / "pagos").iterdir() if p.name.startswith("entrega=")]) == 2
    assert read_target(spark, target, SCHEMA).count() == 2


def test_another_writer_took_the_number(spark, tmp_path):
    first, second = Manifest(spark, str(tmp_path)), Manifest(spark, str(tmp_path))
    entry = lambda n: Entry(n, [n], [], 1)

    def change(live):
        if not live:
            second.commit(lambda before: [*before, entry("other")])
        return [*live, entry("own")]

    first.commit(change)
    assert [e.folder for e in first.read()] == ["other", "own"] and first.versions() == [1, 2]


def test_a_bucketed_target_is_not_shuffled(spark, tmp_path):
    target, name = str(tmp_path / "pagos"), "pagos_ids"
    spark.sql(f"DROP TABLE IF EXISTS {name}")

    def load(batch, *values):
        load_batch(payments(spark, [AP | dict(valor=v) for v in values]), "pagos", target, batch)
        index_ids(spark, name, target, buckets=8)

    def held(ids, **options):
        return sorted(r[0] for r in held_ids(spark, name, target, ids, **options).collect())

    try:
        load("b1", "1", "2")
        load("b2", "3")
        every = read_target(spark, target, SCHEMA).select("id_registro")
        assert held(every) == sorted(r[0] for r in every.collect()) and len(held(every, before_batch="b2")) == 2
        plan = held_ids(spark, name, target, every.union(every))._jdf.queryExecution().executedPlan().toString()
        # One for the batch's distinct ids, none for the target's.
        assert "SelectedBucketsCount: 8 out of 8" in plan
        assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 1
        # Replaced and compacted folders leave the index.
        load("b1", "2")
        assert len(held(every)) == 2
        compact(spark, target, SCHEMA)
        index_ids(spark, name, target, buckets=8)
        assert len(held(every)) == 2 and spark.sql(f"SHOW PARTITIONS {name}").count() == 1
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_compacted_batches_are_still_replaced(spark, tmp_path):
    target = str(tmp_path / "pagos")

    def load(n, *values):
        return load_batch(payments(spark, [AP | dict(valor=v) for v in values]), "pagos", target, f"b{n}").metrics

    for n in range(4):
        load(n, str(n + 1), str(n + 11))
    assert compact(spark, target, SCHEMA) == 4
    entries = Manifest(spark, target).read()
    assert len(entries) == 1 and read_target(spark, target, SCHEMA).count() == 8
    assert load(9, "1", "99")["existentes"] == 1
    assert load(2, "3") == load(2, "3")
    assert sorted(int(r.valor) for r in read_target(spark, target, SCHEMA).collect()) == [1, 2, 3, 4, 11, 12, 14, 99]
    history = {(r.lote, r.medida): r.valor for r in load_history(spark, target).collect()}
    assert history["b2", "nuevos"] == "1" and history["b0", "validos"] == "2" and history["b9", "existentes"] == "1"


def test_a_batch_loaded_while_folders_are_put_together(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "pagos")
    for n in range(2):
        load_batch(payments(spark, [AP | dict(valor=str(n + 1))]), "pagos", target, f"b{n}")
    plain = Manifest.commit

    def late(self, change):
        monkeypatch.setattr(Manifest, "commit", plain)
        load_batch(payments(spark, [AP | dict(valor="7")]), "pagos", target, "b1")
        return plain(self, change)

    monkeypatch.setattr(Manifest, "commit", late)
    assert compact(spark, target, SCHEMA) == 0
    assert sorted(int(r.valor) for r in read_target(spark, target, SCHEMA).collect()) == [1, 7]


@pytest.mark.parametrize("table", ["gestiones", "sms"])
def test_counted_feeds_load_once(spark, tmp_path, table):
    def clean():
        if table == "gestiones":
            return contacts(spark, [CONTACT, CONTACT, CONTACT | {"Funcionario": None}])
        return clean_messages(rows(spark, feeds.MESSAGE_COLUMNS, [MESSAGE, MESSAGE, MESSAGE | {"FECHA": "x"}]))

    target = str(tmp_path / table)
    first = load_batch(clean(), table, target, "b1").metrics
    assert (first["validos"], first["con_error"], first["nuevos"]) == (2, 1, 2)
    again = load_batch(clean(), table, target, "b2").metrics
    assert (again["existentes"], again["nuevos"]) == (2, 0)
    held = read_target(spark, target, storage_schema(feeds.TARGETS[table]))
    assert held.count() == 2 and held.columns[:-2] == list(feeds.TARGETS[table])


def test_rows_the_target_does_not_take(spark, tmp_path):
    long_name = payments(spark, [AP | dict(nombres="N" * 60), AP])
    fitting, unfit = fit_target(long_name.valid, feeds.PAYMENT_TARGET)
    assert fitting.count() == 1 and unfit.first().reasons == ["nombre_usuario excede 50"]
    loaded = load_batch(long_name, "pagos", str(tmp_path / "p"), "b1")
    assert loaded.metrics["nuevos"] == 1 and loaded.new.count() == 1 and loaded.errors.count() == 1
    assert unfit_rows(long_name.valid, feeds.PAYMENT_TARGET).count() == 0


def test_load_without_valid_rows(spark, tmp_path):
    target = str(tmp_path / "p")
    loaded = load_batch(payments(spark, [AP | dict(valor="0")]), "pagos", target, "b1")
    assert loaded.new.isEmpty() and read_target(spark, target, SCHEMA).isEmpty()


def test_structure_check(spark, tmp_path):
    result = payments(spark, [AP])
    result.rows = result.rows.drop("documento")
    with pytest.raises(MissingColumns, match="documento"):
        load_batch(result, "pagos", str(tmp_path / "p"), "b1")


def test_created_tables(spark, tmp_path):
    for name, columns in feeds.TARGETS.items():
        for _ in range(2):
            create_table(spark, f"t_{name}", columns, str(tmp_path / name))
    rows = payments(spark, [AP]).valid
    append_batch(rows.select(*feeds.PAYMENT_TARGET), str(tmp_path / "pagos"), "fecha_pago", "b1")
    spark.catalog.recoverPartitions("t_pagos")
    assert spark.table("t_pagos").first().documento == "1010"
    assert table_columns(spark, "t_sms") == list(feeds.MESSAGE_TARGET)


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_increment(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        check_increment(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def check_increment(spark):
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("c", 1)], "id_registro string, v int")
    target = spark.createDataFrame([("b",), ("b",), ("z",)], "id_registro string")
    assert [r[0] for r in existing_ids(batch, target).collect()] == ["b"]
    assert sorted(r.id_registro for r in new_rows(batch, target).collect()) == ["a", "a", "c"]
    found = increment(batch, target)
    assert sorted(map(tuple, found.new.collect())) == [("a", 1), ("c", 1)]


def test_observed_counts_without_a_job(spark):
    df, watch = observed(spark.range(10), "rows", F.max("id").alias("m"))
    df.write.format("noop").mode("overwrite").save()
    assert watch.get == {"filas": 10, "m": 9}


def test_reports(spark):
    errors = payments(spark, [AP | dict(fecha_liquida="x", id_usuario=str(i)) for i in range(8)]).errors
    sample, total = sample_errors(errors, "fecha_pago faltante", ["documento"])
    assert [r.documento for r in sample.collect()] == list("01234") and total.first().total == 8
    assert report_name("errores", dt.date(2025, 1, 2)) == "errores_20250102"


def test_file_drop(spark, tmp_path):
    drop, target, state = (tmp_path / n for n in ("drop", "pagos", "state"))
    drop.mkdir()

    def run(checkpoint=state, **options):
        load_dropped(spark, "pagos", str(drop), str(target), str(checkpoint), **options).awaitTermination()
        return read_target(spark, str(target), SCHEMA).count()

    write(drop / "Ap pagados 1.txt", AP_HEADER, agreement("1"), agreement("2"))
    write(drop / "otro.txt", "x", "1")
    told = []
    assert run(on_load=lambda name, metrics: told.append(metrics["nuevos"])) == 2 and told == [2]
    assert run() == 2
    write(drop / "Ap pagados 2.txt", AP_HEADER, agreement("2"), agreement("3"))
    assert run() == 3
    # A new stream over the same folder finds every id it loaded before.
    assert run(tmp_path / "state2", per_batch=1) == 3


def test_workbook_drop(spark, tmp_path):
    drop, target = tmp_path / "drop", str(tmp_path / "sms")
    drop.mkdir()

    def run():
        load_dropped(
            spark, "sms", str(drop), target, str(tmp_path / "state"), reports=str(tmp_path / "reports")
        ).awaitTermination()
        return read_target(spark, target, storage_schema(feeds.MESSAGE_TARGET)).count()

    row = ["CC", 777, "ANA", "2024-01-02", "OK", "hola", "BASE1", 3009876543, "C-9"]
    bad = ["CC", 778, "EVA", "ayer", "OK", "hola", "BASE1", 3009876543, "C-9"]
    (drop / "1 ñ.xlsx").write_bytes(workbook({"h": [feeds.MESSAGE_COLUMNS, row, bad]}))
    assert run() == 1
    (drop / "2.xlsx").write_bytes(workbook({"h": [feeds.MESSAGE_COLUMNS, row, row]}))
    assert run() == 2  # the first row again, and its copy
    reports = spark.read.option("header", True).csv([str(p) for p in (tmp_path / "reports").iterdir()])
    assert [r.documento for r in reports.collect()] == ["778"]


def test_folder_and_direct_rows_agree(spark, tmp_path):
    write(tmp_path / "Ap pagados 1.txt", AP_HEADER, agreement("1"))
    from_file = payments_folder(spark, str(tmp_path)).valid.first()
    raw = dict(zip(feeds.AGREEMENT_COLUMNS, agreement("1").split("\t")))
    schema = ", ".join(f"`{c}` string" for c in [*raw, "archivo_origen"])
    direct = clean_payments(spark.createDataFrame([(*raw.values(), "x")], schema)).valid.first()
    assert from_file.id_registro == direct.id_registro


def test_package_is_shipped_once(spark):
    from tamiz.session import ship

    before = set(spark.sparkContext.listFiles)
    ship(spark)
    ship(spark)
    (archive,) = set(spark.sparkContext.listFiles) - before
    assert archive.endswith("tamiz.zip")
