"""Cases that the driver tables do not hold: nulls in join keys, tiny and huge values, other session zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators.bars import rolling  # noqa: F401
from plumbline.operators.frames import micros
from plumbline.operators.joins import asof_join
from plumbline.operators.quantiles import value_bucket
from plumbline.operators.windows import trailing_stats

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("plan", ["merge", "range"])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join_matches_no_null(spark, plan, direction):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    left = spark.createDataFrame([("a", at(10), 1), (None, at(10), 2), ("a", None, 3), ("b", at(5), 4)], "k string, ts timestamp, i int")
    right = spark.createDataFrame([("a", at(10), 7), (None, at(10), 8), ("a", None, 9), ("b", None, 6)], "k string, ts timestamp, v int")
    out = asof_join(left, right, ["k"], "ts", tolerance=3600, direction=direction, plan=plan)
    assert {r.i: r.r_v for r in out.collect()} == {1: 7, 2: None, 3: None, 4: None}


def test_asof_join_without_tolerance_ignores_null_times(spark):
    left = spark.createDataFrame([("a", T0, 1)], "k string, ts timestamp, i int")
    right = spark.createDataFrame([("a", None, 9)], "k string, ts timestamp, v int")
    assert asof_join(left, right, ["k"], "ts").first().r_v is None


def test_std_of_large_values(spark):
    rows = [("a", T0 + dt.timedelta(hours=h), 1e9 + v) for h, v in enumerate([0, 1, 0, 1, 1, 0])]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    out = trailing_stats(df, ["k"], "ts", -86400 * 30, -1, {"s": ("std", "v")}).orderBy("ts").collect()
    assert out[-1].s == pytest.approx(0.5477225575, rel=1e-6)


def test_buckets_part_values_of_every_size(spark):
    df = spark.range(-50000, 50001).select(F.col("id"), (F.col("id") * 2e-8).alias("x"))
    for scale in (1.0, 1e-290, 1e300):
        got = df.select("id", value_bucket(F.col("x") * scale).alias("b"))
        assert got.select("b").distinct().count() > 30000
        assert max(r["count"] for r in got.groupBy("b").count().collect()) <= 16
    odd = [float("-inf"), -1e308, -1.0, -0.0, 0.0, 5e-324, 1e-310, 1.0, 1e308, float("inf"), float("nan")]
    rows = spark.createDataFrame([(x,) for x in odd], "x double").select(value_bucket(F.col("x")).alias("b")).collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) >= 9


def test_clock_of_timestamps_without_zone(spark):
    rows = [(dt.datetime(2024, 3, 10, 1, 30),), (dt.datetime(2024, 3, 10, 2, 30, 0, 5),), (dt.datetime(2024, 3, 10, 3, 30),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz").select(micros("t").alias("m"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r.m for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [b - a for a, b in zip(got, got[1:])] == [3600_000_005, 3599_999_995]
    assert got[0] == 1710034200_000_000
