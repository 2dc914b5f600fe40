import datetime as dt
import math

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from rill.functions import predicates as P
from rill.functions.scalar import campaign_number, epoch_millis, money_sum, times_ten, window_id
from rill.operators import mapreduce, relational
from rill.plans import registry


def test_conditions_follow_sql_on_nulls(spark):
    df = spark.createDataFrame([(1, "ASIA"), (5, "ASIAN"), (9, "EUROPE"), (None, None)], "a int, s string")
    keep = lambda c: sorted(r.a for r in df.where(c).collect())
    assert keep(P.gt("a", 1)) == [5, 9]
    assert keep(P.lt("a", 9)) == [1, 5]
    assert keep(P.eq("s", "ASIA")) == [1]
    assert keep(P.char_prefix_eq("s", "ASIA")) == [1, 5]
    assert keep(P.like("s", "%SI_%")) == [1, 5]
    assert keep(P.char_prefix_gt("s", "ASIA")) == [9] and keep(P.char_prefix_gt("s", "ASH")) == [1, 5, 9]
    assert keep(P.char_prefix_lt("s", "ASIB")) == [1, 5] and keep(P.char_prefix_lt("s", "ASIA")) == []
    assert keep(P.all_of([P.gt("a", 1), P.lt("a", 9)])) == [5]
    assert df.where(P.all_of([])).count() == 4


@pytest.mark.parametrize("text", ["2024-01-31 23:59:59.999", "1970-01-01 00:00:00", "1969-12-31 23:59:59.001", "2024-03-31 02:30:00"])
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_epoch_millis_ignores_the_session_zone(spark, text, zone):
    at = dt.datetime.fromisoformat(text)
    want = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql(f"select timestamp_ntz'{text}' ts").select(epoch_millis("ts").alias("ms"))
        got = df.select("ms", window_id(F.col("ms"), 10_000).alias("w")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (got.ms, got.w) == (want, want // 10_000)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ffffffff-0000",), ("00000010-0000",)], "u string")
    assert [r[0] for r in df.select(campaign_number("u")).collect()] == [4294967295, 16]
    df = spark.createDataFrame([(3, 0.1), (4, 0.2)], "v int, m double")
    assert [r[0] for r in mapreduce.map_values(df, "v", times_ten, times_ten).collect()] == [300, 400]
    assert df.agg(money_sum(F.col("m"))).first()[0] == 0.3


def test_distinct_compares_whole_values(spark):
    df = spark.createDataFrame([("NATION_1", 1), ("NATION_2", 1), ("NATION_1", 1), (None, 1), (None, 1)], "s string, k int")
    assert relational.select_distinct(df).count() == 3
    assert relational.select_project_distinct(df, [P.eq("k", 1)], ["k"]).count() == 1


def test_global_aggregate_of_no_rows_is_one_row(spark):
    df = spark.createDataFrame([], "v double")
    row = relational.group_all(df, {"n": F.count(F.lit(1)), "mx": F.max("v")}).collect()
    assert [tuple(r) for r in row] == [(0, None)]


def test_maximum_of_negative_values(spark):
    df = spark.createDataFrame([(1, -5.0), (1, -2.0)], "k int, v double")
    assert relational.group_by(df, ["k"], {"mx": F.max("v")}).first().mx == -2.0


def test_join_of_frames_with_equal_names_and_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r")], "k int, v string")
    got = relational.equi_join(a, b, [("k", "k")], ["k", "v"], ["v"]).collect()
    assert sorted((r[1], r[2]) for r in got) == [("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")]


def test_sorts_are_in_order(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (1, "a"), (None, "z")], "k int, s string")
    assert [tuple(r) for r in relational.sort_by(df, ["k", "s"]).collect()] == [(None, "z"), (1, "a"), (1, "c"), (3, "b")]
    assert [r.s for r in relational.top_n(df, ["s"], 2).collect()] == ["a", "b"]


def test_a_partition_is_reduced_as_a_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(20).coalesce(1).withColumnRenamed("id", "v")
        assert [r.v for r in mapreduce.combine_partitions_python(df, "v", len).collect()] == [20]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_opaque_aggregate_meets_part_of_a_group_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(mapreduce, "CHUNK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = spark.range(0, 40, 1, 2).selectExpr("id % 2 a", "if(id % 2 = 0, null, struct(id % 4 b)) s", "id v")
        got = mapreduce.aggregate_python(df, ["a", "s"], "v", [len, lambda v: pc.sum(v).as_py()], lambda n, _: pc.max(n).as_py(), "n")
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
        assert max(r.n for r in got.collect()) <= 8
        got = mapreduce.aggregate_python(df, ["a", "s"], "v", [len, lambda v: pc.sum(v).as_py()], lambda n, v: pc.sum(n).as_py() * 1000 + pc.sum(v).as_py(), "n")
        assert {(r.a, r.s and r.s.b): r.n for r in got.collect()} == {(0, None): 20380, (1, 1): 10190, (1, 3): 10210}
        assert [r.n for r in mapreduce.aggregate_python(df, [], "v", [len], lambda n: pc.sum(n).as_py(), "n").collect()] == [40]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spread_of_nulls_and_nan(spark, monkeypatch):
    rows = [("A", None), ("A", None), ("N", 1.0), ("N", None), ("N", 3.5), ("R", 2.0), ("R", math.nan), (None, -0.5), (None, -2.0)]
    df = spark.createDataFrame(rows, "l_returnflag string, l_quantity double")
    monkeypatch.setattr(registry, "table", lambda *_: df)
    got = {r.l_returnflag: r.spread for r in registry.QUERIES["aggregate_python"](spark, "").collect()}
    assert math.isnan(got.pop("R")) and got == {"A": None, "N": 2.5, None: 1.5}
