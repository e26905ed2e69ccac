"""Column functions on literal rows."""

import hashlib
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tamiz.functions import dates, identity, numbers, text


def values(spark, cells, column):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


C = None


@pytest.fixture(scope="module", autouse=True)
def column(spark):
    global C
    C = F.col("c")


def test_null_tokens(spark):
    cells = ["", " ", "NULL", "nan", "NaN", " null ", "x", None, "NA"]
    assert values(spark, cells, text.null_tokens(C, text.WORKBOOK_NULLS)) == [None] * 5 + [" null ", "x", None, "NA"]
    assert values(spark, cells, text.null_tokens(C, text.READER_NULLS)) == [None, " ", None, None, None, " null ", "x", None, None]


def test_text(spark):
    assert values(spark, ["\t a b \n", " x　", None], text.strip(C)) == ["a b", "x", None]
    assert values(spark, ["3001234567.0", "1.50", "-7.0", "a.0", "7.0\n"], text.integral_text(C)) == ["3001234567", "1.50", "-7", "a.0", "7.0\n"]
    phones = ["1234567", "123456", "123456789012345", "1234567890123456", "+573001234567", "1234567\n", "１２３４５６７", None]
    assert values(spark, phones, text.is_phone(C)) == [True, False, True, False, False, False, False, False]
    assert values(spark, ["ANA", None], text.full_name(C, F.lit("GIL"))) == ["ANA GIL", "GIL"]
    assert values(spark, [None], text.full_name(C, C)) == [""]
    assert values(spark, ["", "a", None], text.first_filled(C, F.lit("b"))) == ["b", "a", "b"]
    assert values(spark, [" a ", None], text.joined_code(C, F.lit(" b"))) == ["a_b", None]
    assert values(spark, ["ñandú"], text.truncate(C, 2)) == ["ña"]


def test_numbers(spark):
    cells = ["12.99", "-12.99", "abc", "inf", "12d", "1,000", " 7 ", "1e3", None]
    got = values(spark, cells, numbers.to_decimal(C).cast("string"))
    assert got == ["12.99", "-12.99", None, None, None, None, "7.00", "1000.00", None]
    assert values(spark, ["7", "7.0", "1.5", "x", "99999999999999999999"], numbers.to_bigint(C)) == [7, 7, None, None, None]
    total = numbers.truncated_sum(C, F.lit("0.98"))
    assert values(spark, ["12.01", "12.02", "-13.97", "x", None], total) == ["12", "13", "-12", "0", "0"]
    assert values(spark, ["12.02", None], numbers.truncated_sum(C, F.lit("0.98"), False)) == ["13", None]
    assert values(spark, ["99999999999999.99"], numbers.to_decimal(C, 15, 2)) == [None]


@pytest.mark.parametrize("cell, strict, lenient", [
    ("2024-1-2", date(2024, 1, 2), None),
    ("2024-01-02", date(2024, 1, 2), datetime(2024, 1, 2)),
    ("2024-01-02 00:00:00", date(2024, 1, 2), datetime(2024, 1, 2)),
    ("2024-01-02 03:04:05", None, datetime(2024, 1, 2, 3, 4, 5)),
    ("13/01/2024", None, datetime(2024, 1, 13)),
    ("02/01/2024", None, datetime(2024, 1, 2)),
    ("2024-02-30", None, None),
    ("24-1-2", None, None),
    ("2024", None, None),
])
def test_dates(spark, cell, strict, lenient):
    assert values(spark, [cell], dates.parse_date_strict(C)) == [strict]
    assert values(spark, [cell], dates.parse_timestamp(C)) == [lenient]
    assert values(spark, [cell], dates.parse_day(C)) == [lenient and lenient.date()]


def test_other_formats_are_tried_without_a_shape(spark):
    assert values(spark, ["05 Mar 2024"], dates.parse_day(C, ["dd MMM yyyy"])) == [date(2024, 3, 5)]
    assert dates.shape("dd MMM yyyy EEE") is None


@pytest.mark.parametrize("zone", ["UTC", "America/Bogota", "Europe/Madrid"])
def test_epoch_text_is_that_of_python(spark, zone):
    start = datetime(1970, 1, 1)
    moments = [start + timedelta(seconds=s, microseconds=u) for s, u in (
        (1704164645, 0), (1704164645, 120000), (1704164645, 123456), (-2, 500000), (-86401, 0), (0, 0), (1711846800, 1), (1711850400, 0))]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, t timestamp_ntz")
        got = [r[0] for r in df.orderBy("i").select(dates.epoch_text(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [str((m - start).total_seconds()) if (m - start).microseconds != 1 else "1711846800.000001" for m in moments]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.none() | st.text(max_size=5), st.none() | st.integers(-10**9, 10**9)), min_size=1, max_size=20))
def test_ids_are_plain_sha256(spark, rows):
    rows = [(a and a.encode("utf-8", "ignore").decode(), b) for a, b in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b bigint")
    got = [r[0] for r in df.orderBy("i").select(identity.record_id(F.col("a"), F.col("b"))).collect()]
    assert got == [hashlib.sha256(f"{a or ''}_{'' if b is None else b}".encode()).hexdigest() for a, b in rows]


def test_safe_ids_keep_fields_apart(spark):
    a, b = (F.lit("a_b"), F.lit("c")), (F.lit("a"), F.lit("b_c"))
    row = spark.range(1).select(
        *[identity.record_id(*f, safe=s).alias(n) for n, f, s in (("p", a, False), ("q", b, False), ("r", a, True), ("s", b, True))]
    ).first()
    assert row.p == row.q and row.r != row.s
