"""Schema, quality, duplicate and profile operators."""

import pytest
from pyspark.sql import functions as F

from tamiz.operators import duplicates, profile, quality, schema
from tamiz.plans.result import Result, no_warnings
from tamiz.session import scratch, shared_folder


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [("f1", "a", 1), ("f1", "a", 2), ("f1", None, 3), ("f2", "b", 4), ("f2", None, 5)],
        "archivo_origen string, k string, v int",
    )


def test_columns(spark, people):
    assert schema.require_columns(people, ["k"]) is people
    with pytest.raises(schema.MissingColumns, match="x, y"):
        schema.require_columns(people, ["x", "k", "y"])
    assert schema.keep_available(people, ["v", "x", "k"]).columns == ["v", "k"]
    added = schema.add_missing(people, ["k", "x"])
    assert added.columns[-1] == "x" and added.where("x is null").count() == 5
    swapped = schema.rename(people, {"k": "v", "v": "k"})
    assert swapped.columns == ["archivo_origen", "v", "k"] and swapped.first().v == "a"
    assert schema.fill_defaults(people, {"k": "z"}).where("k = 'z'").count() == 2
    named = schema.with_lineage(people, "x.txt").first()
    assert named.archivo_origen == "x.txt" and named.fecha_carga is not None


def test_target_checks(people):
    target = ["archivo_origen", "k", "v", "w"]
    assert schema.check_target(people, target) is people
    with pytest.raises(schema.MissingColumns, match="w"):
        schema.check_target(people, target, exact=True)
    with pytest.raises(schema.MissingColumns, match="'v'"):
        schema.check_target(people, ["archivo_origen", "k"])


def test_union(spark, people):
    got = schema.union_by_name(people, people.select("v"), people.drop("v"))
    assert got.count() == 15 and got.columns == people.columns


def test_reasons_cover_every_row_once(people):
    checked = quality.add_reasons(people, quality.missing_rules(["k"]) | {"v alto": F.col("v") > 4})
    assert quality.valid_rows(checked).count() + quality.error_rows(checked).count() == 5
    texts = {r.v: r.t for r in checked.select("v", quality.reason_text().alias("t")).collect()}
    assert texts == {1: "", 2: "", 3: "k faltante", 4: "", 5: "k faltante; v alto"}
    assert people.where(quality.any_missing(["k", "v"])).count() == 2


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_rejected_files(spark, people, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        failed = quality.files_with_duplicates(people, "k", "dup").union(
            quality.failing_files(people, {"bajo": F.col("v") < 2, "alto": F.col("v") > 9}))
        split = quality.reject_files(people, failed)
        assert list(map(tuple, split.failed.collect())) == [("f1", "bajo; dup")]
        assert split.kept.count() == 2 and split.rejected.count() == 3
        plan = split.kept._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (threshold != "-1")
        assert duplicates.duplicate_rows(people, ["k"]).count() == 4  # nulls are equal
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_duplicates(people):
    assert {r.n for r in duplicates.duplicate_keys(people, ["k"]).collect()} == {2}
    repeated = duplicates.repeated_ids(people, ["archivo_origen", "k"]).collect()
    assert list(map(tuple, repeated)) == [("f1", "a", 2)]
    assert sorted(duplicates.repeated_ids(people, ["k"]).collect(), key=repr) == sorted(
        duplicates.duplicate_keys(people, ["k"]).collect(), key=repr)
    one = duplicates.one_per_key(people.where("k is not null"), "k").collect()
    assert sorted((r.k, r.v) for r in one) == [("a", 1), ("b", 4)]


def test_profiles(people):
    assert [tuple(r) for r in profile.value_counts(people, "k").collect()] == [("a", 2), ("b", 1)]
    assert {r.columna: r.longitud for r in profile.max_lengths(people).collect()} == {"archivo_origen": 2, "k": 1, "v": 1}
    assert {r.columna: (r.filas, r.no_nulos, r.tipo) for r in profile.table_profile(people).collect()}["k"] == (5, 3, "string")
    assert [r.v for r in profile.head(people, 2, "v").collect()] == [1, 2]
    assert [r.v for r in profile.tail(people, 2, "v").collect()] == [5, 4]
    assert [r.v for r in profile.row_slice(people, 1, 3, "v").collect()] == [2, 3]
    assert profile.max_lengths(people.where("false")).first().longitud == 0


def test_staged_rows_are_stored_once(spark, people):
    checked = quality.add_reasons(people, quality.missing_rules(["k"]))
    result = Result(checked, people, people, no_warnings(spark)).staged()
    assert result.stored and result.staged() is result
    plan = result.valid._jdf.queryExecution().optimizedPlan().toString()
    assert "stored-" in result.rows.inputFiles()[0] and "LogicalRDD" not in plan
    assert result.valid.count() == 3


def test_scratch_lies_in_the_named_folder(spark):
    assert scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch(spark, "x") != scratch(spark, "x")
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
