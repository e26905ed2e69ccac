"""The counter: hot groups are split without changing any number."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamiz.operators import counter as module
from tamiz.operators.counter import group_counter, repeated_groups
from tamiz.operators.counter import hot_groups as split_groups


def hot_groups(df, keys, hot_rows):
    hashed = df.select(F.xxhash64(*keys).alias(module._HASH))
    return [tuple(r) for r in split_groups(repeated_groups(hashed), hot_rows).collect()]


@pytest.fixture
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(300)}", rng.randrange(50), i) for i in range(3000)]
    rows += [("hot", 1, -1)] * 500 + [(None, 2, 5), (None, 2, 6)]
    return spark.createDataFrame(rows, "k string, v int, p bigint").repartition(6)


def test_hot_groups_are_found(spark, skewed):
    assert [bits for _, bits in hot_groups(skewed, ["k"], 1000)] == [1]
    assert [bits for _, bits in hot_groups(skewed, ["k"], 100)] == [4]  # 1500 rows in 16 buckets
    assert hot_groups(skewed, ["k"], 10_000) == []


def test_rows_of_single_groups_are_not_shuffled(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    alone = group_counter(df, ["k"], "n")
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert alone.where("n = 1").count() == 1000
    twice = group_counter(df.union(df.where("k < 5")), ["k"], "n")
    assert twice.where("n = 2").count() == 5 and twice.count() == 1005
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "LeftSemi" in plan and "LeftAnti" in plan


def test_empty_partitions_and_empty_tables(spark, skewed):
    assert hot_groups(skewed.where("false"), ["k"], 1) == []
    assert group_counter(skewed.where("false"), ["k"], "n", hot_rows=1).count() == 0
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len(hot_groups(skewed.where("k is null or k = 'hot'").repartition(40), ["k"], 1000)) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_buckets_hold_about_hot_rows(spark, monkeypatch):
    sizes = []
    inner = module._with_earlier

    def spy(rows, bucketed, keys):
        sizes.append([r["count"] for r in bucketed.groupBy(*keys, "__bucket").count().collect()])
        return inner(rows, bucketed, keys)

    monkeypatch.setattr(module, "_with_earlier", spy)
    # A dense run of positions and one far away.
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.when(F.col("id") == 0, 10**17).otherwise(F.col("id")).alias("p"))
    for position in (None, "p"):
        got = group_counter(df, ["k"], "n", position, hot_rows=100)
        assert got.select("n").distinct().count() == 200_000 and got.agg(F.max("n")).first()[0] == 200_000
        # A far position leaves at most its own interval, a 1/256 part, uneven.
        assert max(sizes[-1]) < 200_000 / 256 + 100 and len(sizes[-1]) > 1000
    ordered = got.orderBy("p").select("n").limit(5).collect()
    assert [r.n for r in ordered] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("position", [None, "p"])
@pytest.mark.parametrize("hot_rows", [1, 100])
@pytest.mark.parametrize("few_groups", [0, 1000])
def test_split_groups_count_like_plain_ones(spark, skewed, position, hot_rows, few_groups):
    df = skewed if position is None else skewed.where("p >= 0")
    plain = group_counter(df, ["k"], "n", position)
    split = group_counter(df, ["k"], "n", position, hot_rows, few_groups)
    assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    sizes = Counter(r.k for r in df.collect())
    for r in split.groupBy("k").agg(F.collect_set("n").alias("s")).collect():
        assert sorted(r.s) == list(range(1, sizes[r.k] + 1))


def test_copies_are_written_out_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(module, "COPY_CHUNK", 7)
    df = spark.createDataFrame([("a", 1)] * 100 + [("a", 2)] * 3, "k string, v int")
    got = group_counter(df, ["k"], "n", hot_rows=10).collect()
    assert sorted(r.n for r in got) == list(range(1, 104))
    assert Counter(r.v for r in got) == {1: 100, 2: 3}


def test_numbers_do_not_depend_on_partitioning(spark, skewed):
    runs = [
        sorted(map(tuple, group_counter(skewed.repartition(n), ["k"], "n", hot_rows=h).collect()), key=repr)
        for n, h in ((1, 10_000), (5, 100))
    ]
    assert runs[0] == runs[1]


def test_position_gives_file_order(spark, skewed):
    got = group_counter(skewed.where("p >= 0"), ["k"], "n", "p", hot_rows=100).where("k = 'hot'")
    ordered = [r.n for r in got.orderBy("p").collect()]
    assert ordered == list(range(1, len(ordered) + 1))
