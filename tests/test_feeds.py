"""Golden ids and row-level decisions of the three feeds."""

import hashlib
import random
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tamiz import feeds
from tamiz.plans.contacts import clean_contacts
from tamiz.plans.messages import clean_messages, consolidate_messages
from tamiz.plans.payments import clean_payments, consolidate_payments


def rows(spark, columns, data, file="f1"):
    schema = ", ".join(f"`{c}` string" for c in [*columns, "archivo_origen"])
    return spark.createDataFrame([tuple(r.get(c) for c in columns) + (r.get("file", file),) for r in data], schema)


AP = dict(nro_acuerdo="900123", id_usuario="1010", nombres="ANA", apellidos="GIL",
          valor="150000.50", fecha_liquida="2025-01-02", consecutivo_cuota="3")
CO = dict(nro_comparendo="C-77", id_usuario="2020", nombres="LUIS", apellidos="PEÑA",
          compute_0004="12000.75", intereses="98.90", fecha_liquida_contrav="2025-01-02 08:15:00")
CO2 = dict(nro_resolucion="R-88", nro_comparendo="", id_usuario="3030", nombres="EVA", apellidos="SOL",
           compute_0004="500", fecha_liquida_contrav="2025-01-03")


def payments(spark, a=(), b=(), **kw):
    return clean_payments(
        rows(spark, feeds.AGREEMENT_COLUMNS, a, "Ap pagados 1.txt"),
        rows(spark, feeds.TICKET_COLUMNS, b, "Comparendos pagados 1.txt"), **kw)


def test_payment_golden_ids(spark):
    got = {r.identificador_infraccion: r for r in payments(spark, [AP], [CO, CO2]).valid.collect()}
    assert got["900123"].id_registro == "e7b64d4717b759b349be8a8eb4b9305fc5531b5b64280d87e240f34ae8ca8f51"
    assert got["C-77"].id_registro == "c16782e1a28cce71498159e3c12aeae46bc4b91f65a6ed281d3793307f2f1567"
    assert got["R-88"].id_registro == "6a253075ee12de9efd57bdebd7acfacbfa049e4a55ff28bd9e31b09d0530acef"
    assert str(got["C-77"].valor) == "12099.00" and got["C-77"].nombre_usuario == "LUIS PEÑA"
    assert str(got["900123"].valor) == "150000.50"


@pytest.mark.parametrize("change, reason", [
    (dict(valor="0"), "valor no positivo"), (dict(valor="-5"), "valor no positivo"),
    (dict(valor="abc"), "valor faltante"), (dict(valor="inf"), "valor faltante"),
    (dict(valor="12d"), "valor faltante"), (dict(valor="1,000"), "valor faltante"),
    (dict(valor="NULL"), "valor faltante"), (dict(id_usuario=None), "documento faltante"),
    (dict(id_usuario="nan"), "documento faltante"),
    (dict(nombres=None, apellidos=None), "nombre_usuario faltante"),
    (dict(fecha_liquida="2024-02-30"), "fecha_pago faltante"),
    (dict(nro_acuerdo=None), "identificador_infraccion faltante"),
])
def test_payment_reasons(spark, change, reason):
    result = payments(spark, [AP | change])
    assert result.valid.count() == 0
    assert reason in result.errors.first().reasons


def test_payment_partial_names_and_dates(spark):
    a = [AP | dict(nombres=None, valor="1"), AP | dict(fecha_liquida="13/01/2024", valor="2")]
    got = {r.valor: r for r in payments(spark, a).valid.collect()}
    assert sorted(r.nombre_usuario for r in got.values()) == ["ANA GIL", "GIL"]
    assert str(got[2].fecha_pago) == "2024-01-13 00:00:00"


def test_duplicates_reject_only_their_file(spark):
    a = [AP, AP, AP | dict(valor="7"), AP | dict(file="Ap pagados 2.txt")]
    result = payments(spark, a)
    assert result.failed_files.collect() == [("Ap pagados 1.txt", "ids duplicados")]
    assert result.rejected.count() == 3 and result.valid.count() == 1
    bad_twice = [AP | dict(valor="0"), AP | dict(valor="0")]
    assert payments(spark, bad_twice).failed_files.count() == 0  # checked among valid rows only


def test_duplicate_policies(spark):
    a = [AP, AP, AP | dict(valor="7"), AP | dict(valor="0")]
    quarantined = payments(spark, a, on_duplicate="quarantine")
    assert quarantined.valid.count() == 1 and quarantined.errors.count() == 3
    counted = payments(spark, a, on_duplicate="count")
    assert counted.valid.count() == 3
    assert counted.warnings.first().detail == "2"


def test_payments_without_optional_columns(spark):
    raw = rows(spark, feeds.TICKET_COLUMNS, [CO]).drop("intereses")
    result = clean_payments(None, raw)
    assert result.errors.first().reasons == ["valor faltante"]
    assert result.warnings.first().detail == "intereses"
    assert payments(spark, [AP], [CO]).warnings.isEmpty()


def test_consolidated_payments_keep_missing_amounts(spark):
    got = consolidate_payments(
        rows(spark, feeds.AGREEMENT_COLUMNS, [AP]), rows(spark, feeds.TICKET_COLUMNS, [CO, CO2])
    )
    assert got.columns == ["nro_acuerdo", "nro_comparendo", "id_usuario", "nombre_usuario",
                           "valor", "fecha_pago", "archivo_origen"]
    assert {r.nro_comparendo: r.valor for r in got.collect()} == {None: "150000.50", "C-77": "12099", "R-88": None}


CONTACT = {"Número documento": "555", "Teléfono": "3001234567", "Funcionario": "agente1",
           "Fecha gestión": "2024-01-02 03:04:05", "Obligación": "OB-1", "Resultado": "CONTACTO"}


def contacts(spark, data, **kw):
    return clean_contacts(rows(spark, feeds.CONTACT_COLUMNS, data), **kw)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_contact_golden_ids(spark, hot_rows):
    got = contacts(spark, [CONTACT, CONTACT], hot_rows=hot_rows).valid.collect()
    assert sorted(r.id_registro for r in got) == [
        "70a9c4e80020e8ada51d57a4d07bf34c4ddc6367cd5689db495e3a562e995ac5",
        "9e47ae63ab3a16db5b3f6d008245e6d32d769e861131ecf65bc3a68a089725bf",
    ]
    row = got[0]
    assert row.id_gestion == "555_3001234567" and row.tipo_llamada == "Saliente"
    assert row.campana == "SIN CAMPAÑA" and row.nombre_usuario == "sin registro"
    assert str(row.valor) == "0.00" and row.fecha_gestion_sencilla == "2024-01-02"


def test_contact_fallbacks_and_reasons(spark):
    data = [
        CONTACT | {"Teléfono": " ", "Obligación": None, "Nro. Comparendo": "N-1", "Valor": "12.345"},
        CONTACT | {"Número documento": "NULL", "Funcionario": "nan"},
        CONTACT | {"Valor": "99999999999999"},
        CONTACT | {"Resultado": None, "Fecha Compromiso": "2024-05-06 10:00:00"},
    ]
    result = contacts(spark, data)
    good = result.valid.first()
    assert good.telefono == "555" and good.identificador_infraccion == "N-1" and str(good.valor) in ("12.35", "12.34")
    assert str(result.rows.where("fecha_compromiso is not null").first().fecha_compromiso) == "2024-05-06"
    reasons = sorted(r.reasons for r in result.errors.collect())
    assert reasons == [["documento faltante", "asesor faltante", "id_gestion faltante"], ["resultado faltante"], ["valor fuera de rango"]]


def test_contact_date_policies(spark):
    data = [CONTACT, CONTACT | {"Fecha gestión": "2024-02-30", "file": "f2"}, CONTACT | {"file": "f2"}]
    rejecting = contacts(spark, data)
    assert rejecting.failed_files.first().archivo_origen == "f2"
    assert rejecting.valid.count() == 1 and rejecting.rejected.count() == 2
    row_wise = contacts(spark, data, on_bad_date="quarantine_row")
    assert row_wise.valid.count() == 2
    assert row_wise.errors.first().reasons == ["fecha_gestion faltante"]


def test_colliding_keys_still_get_distinct_ids(spark):
    a = CONTACT | {"Resultado": "x_y", "Obligación": "o"}
    b = CONTACT | {"Resultado": "y", "Obligación": "o_x"}
    got = contacts(spark, [a, b]).valid
    assert got.select("id_registro").distinct().count() == 2


MESSAGE = {"DOCUMENTO": "777", "TELEFONO": "3009876543", "FECHA": "2024-01-02", "NRO_COMPARENDO": "C-9", "BASE": "BASE1"}


def test_message_golden_ids(spark):
    data = [MESSAGE, MESSAGE | {"DOCUMENTO": " ", "NRO_COMPARENDO": None, "TELEFONO": "3009876544.0"}]
    got = {r.documento: r for r in clean_messages(rows(spark, feeds.MESSAGE_COLUMNS, data)).valid.collect()}
    assert got["777"].id_registro == "5138fac0ec61daff7fe99f01a3acc68ca15fd674fe395f20d3d10747f92c0aa8"
    assert got["3009876544"].id_registro == "db4a30a281bb299e29eeaef2e9825fc2c8a5f7035012c2fca6d5ac11de00a895"
    assert got["3009876544"].identificador_infraccion == ""


def test_message_errors_and_lengths(spark):
    data = [
        MESSAGE | {"TELEFONO": "123456"}, MESSAGE | {"TELEFONO": "+573001234567"},
        MESSAGE | {"FECHA": "2024-01-02 10:00:00"}, MESSAGE | {"FECHA": "13/01/2024"},
        MESSAGE | {"TELEFONO": None}, MESSAGE | {"FECHA": "2024-1-2", "SMS": "ñ" * 300},
        MESSAGE | {"FECHA": "2024-01-02 00:00:00", "SMS": "b"},
    ]
    result = clean_messages(rows(spark, feeds.MESSAGE_COLUMNS, data))
    texts = sorted(r.texto_sms for r in result.valid.collect())
    assert texts == ["b", "ñ" * 250]
    reasons = sorted(r.reasons[0] for r in result.errors.collect())
    assert reasons == ["fecha_sms faltante"] * 2 + ["telefono faltante"] + ["telefono no válido"] * 2
    bad = result.errors.where(F.array_contains("reasons", "fecha_sms faltante"))
    empty = hashlib.sha256("777_3009876543_fecha_vacia_C-9_BASE1_1".encode()).hexdigest()
    assert empty not in {r.id_registro for r in bad.collect()}  # a readable moment is hashed


def untidy(rng, n):
    pick = rng.choice
    return [
        {
            "Número documento": pick(["1", "2", "NULL", None]), "Teléfono": pick(["7", " ", "8"]),
            "Funcionario": pick(["a", "b", "nan"]), "Fecha gestión": pick(["2024-01-02", "2024-01-02 03:04:05", "02/01/2024"]),
            "Código gestión": pick(["", "c"]), "Resultado": pick(["r", "s"]), "Obligación": pick([None, "o"]),
            "Nombre": str(rng.randrange(3)), "Valor": pick(["1", "x"]), "file": pick(["f1", "f2"]),
        }
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_nothing_is_lost_and_ids_are_repeatable(spark, seed):
    rng = random.Random(seed)
    data = untidy(rng, 400)
    runs = []
    for partitions, hot_rows in ((1, 10**6), (7, 10**6), (3, 5)):
        rng.shuffle(data)
        raw = rows(spark, feeds.CONTACT_COLUMNS, data).repartition(partitions)
        result = clean_contacts(raw, hot_rows=hot_rows)
        valid, errors = result.valid, result.errors
        assert valid.count() + errors.count() + result.rejected.count() == 400
        assert result.rows.select("archivo_origen", "id_registro").distinct().count() == 400
        runs.append(sorted(map(tuple, result.rows.drop("fecha_carga").collect()), key=repr))
    assert runs[0] == runs[1] == runs[2]


def plain_message_ids(data):
    """The ids of clean messages, computed row by row."""
    seen, ids = Counter(), []
    for r in data:
        moment = datetime.fromisoformat(r["FECHA"]).replace(tzinfo=timezone.utc).timestamp()
        key = "_".join([r["DOCUMENTO"], r["TELEFONO"], str(moment), r["NRO_COMPARENDO"] or r["DOCUMENTO"], r["BASE"]])
        seen[key] += 1
        ids.append(hashlib.sha256(f"{key}_{seen[key]}".encode()).hexdigest())
    return ids


def test_message_ids_match_a_plain_computation(spark):
    rng = random.Random(5)
    data = [
        {"DOCUMENTO": str(rng.randrange(5)), "TELEFONO": f"300000000{rng.randrange(3)}", "FECHA": f"2024-01-0{rng.randrange(1, 4)}",
         "NRO_COMPARENDO": rng.choice([None, "C-1"]), "BASE": rng.choice("ab"), "SMS": str(i)}
        for i in range(500)
    ]
    raw = rows(spark, feeds.MESSAGE_COLUMNS, data).withColumn("p", F.col("SMS").cast("bigint"))
    got = clean_messages(raw.repartition(5), position="p").valid.collect()
    assert {r.texto_sms: r.id_registro for r in got} == {d["SMS"]: i for d, i in zip(data, plain_message_ids(data))}


@pytest.mark.parametrize("policy", ["reject_file", "quarantine", "count"])
def test_stored_and_computed_rows_agree(spark, policy):
    a = [AP, AP, AP | dict(valor="7"), AP | dict(file="Ap pagados 2.txt"), AP | dict(valor="x")]
    shown = [
        (sorted(map(tuple, r.valid.drop("fecha_carga").collect())), r.errors.count(), r.rejected.count())
        for r in (payments(spark, a, [CO], on_duplicate=policy, stage=s) for s in (True, False))
    ]
    assert shown[0] == shown[1]


def test_messages_are_renamed_at_once(spark):
    sheet = spark.createDataFrame([("cc", "Ana", "B1")], "`DESC_DOCUMENTO` string, `NOMBRES` string, `NOMBRE` string")
    other = spark.createDataFrame([("ti", "x")], "`DESC_DOCUMENTO` string, `SMS` string")
    got = consolidate_messages(sheet, other)
    assert got.columns == ["TIPO DOCUMENTO", "NOMBRE", "BASE", "TEXTO"]
    assert sorted(tuple(r) for r in got.collect())[0] == ("CC", "Ana", "B1", None)
