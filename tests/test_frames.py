"""The split frames equal plain windows, also where one key holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators import frames, quantiles, windows
from plumbline.operators.joins import asof_join

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(8)}"
        ts = T0 + dt.timedelta(seconds=rng.randrange(4 * 86400))
        value = None if rng.random() < 0.1 else round(rng.random() * 100, 2)
        rows.append((i, key, ts, value, rng.random() < 0.3))
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, value double, hit boolean").cache()


def rows_of(df, *cols):
    return {r["id"]: tuple(None if r[c] is None else round(r[c], 6) for c in cols) for r in df.collect()}


def test_tick_frame(skewed):
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", "value"), "m": ("avg", "value"), "sd": ("std", "value"),
            "lo": ("min", "value"), "hi": ("max", "value")}
    got = frames.tick_frame(skewed, ["key"], frames.seconds("ts"), -7200, -60, aggs)
    w = W.partitionBy("key").orderBy(F.unix_timestamp("ts")).rangeBetween(-7200, -60)
    v = F.col("value")
    want = skewed.select(
        "id", F.count(F.lit(1)).over(w).alias("n"), F.sum(v).over(w).alias("s"), F.avg(v).over(w).alias("m"),
        F.stddev_samp(v).over(w).alias("sd"), F.min(v).over(w).alias("lo"), F.max(v).over(w).alias("hi"),
    )
    cols = ("n", "s", "m", "lo", "hi")
    assert rows_of(got, *cols) == rows_of(want, *cols)
    a, b = rows_of(got, "sd"), rows_of(want, "sd")
    assert all((a[i][0] is None) == (b[i][0] is None) for i in a)
    assert all(a[i][0] is None or abs(a[i][0] - b[i][0]) < 1e-4 for i in a)


@pytest.mark.parametrize("current", [True, False])
def test_running(skewed, current):
    specs = {"n": ("count", "value"), "s": ("sum", "value"), "hi": ("max", "value"), "last": ("last", "value")}
    order = [frames.micros("ts"), F.col("id")]
    got = frames.running(skewed, ["key"], frames.slice_of(frames.seconds("ts"), 3600), order, specs, current)
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0 if current else -1)
    want = skewed.select(
        "id", F.count("value").over(w).alias("n"), F.sum("value").over(w).alias("s"), F.max("value").over(w).alias("hi"),
        F.last("value", ignorenulls=True).over(w).alias("last"),
    )
    assert rows_of(got, *specs) == rows_of(want, *specs)


def test_row_frame_crosses_chunks(skewed):
    def exprs(w):
        return {"m": F.avg("value").over(w.rowsBetween(-4, 0)), "p": F.lag("value", 2).over(w), "x": F.lead("value").over(w)}

    got = frames.row_frame(
        skewed, ["key"], frames.slice_of(frames.seconds("ts"), 3600), [frames.micros("ts"), F.col("id")], 4, 1, exprs, chunk=7
    )
    w = W.partitionBy("key").orderBy("ts", "id")
    want = skewed.select("id", *[c.alias(n) for n, c in exprs(w).items()])
    assert rows_of(got, "m", "p", "x") == rows_of(want, "m", "p", "x")


def test_quantiles_match_percentile(skewed):
    t = skewed.withColumn("neg", F.col("value") - 50)
    got = {
        (r["key"], r["metric"], r["prob"]): round(r["quantile"], 6)
        for r in quantiles.exact_quantiles(t, ["key"], ["value", "neg"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()
    }
    for c in ("value", "neg"):
        for r in t.groupBy("key").agg(F.percentile(c, [0.0, 0.1, 0.5, 0.99, 1.0]).alias("q")).collect():
            for p, q in zip((0.0, 0.1, 0.5, 0.99, 1.0), r["q"]):
                assert got[(r["key"], c, p)] == pytest.approx(q, abs=1e-6)


def test_value_bucket_is_monotone(spark):
    values = [float("-inf"), -1e9, -3.5, -1e-9, 0.0, 1e-9, 0.5, 3.5, 1e9, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(quantiles.value_bucket(F.col("v")).alias("b"))
    buckets = [r["b"] for r in df.collect()]
    assert buckets == sorted(buckets)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "id int, v double")
    got = {r["id"]: r["r"] for r in quantiles.average_ranks(df, [], "v", "r").collect()}
    assert got == {1: 2.5, 2: 2.5, 3: 1.0, 4: None}


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "a", T0 + dt.timedelta(hours=6)), (2, "a", T0 + dt.timedelta(hours=7)),
                                  (3, "b", T0), (4, "a", T0)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", T0, 10), ("a", T0, 11)], "k string, ts timestamp, v int")
    for plan in ("merge", "range"):
        got = {r["id"]: (r["r_v"], r["lag_minutes"]) for r in asof_join(left, right, ["k"], "ts", 21600, plan=plan).collect()}
        # Exactly at the tolerance counts, beyond it does not; ties go to the larger row.
        assert got == {1: (11, 360), 2: (None, None), 3: (None, None), 4: (11, 0)}
    strict = {r["id"]: r["r_v"] for r in asof_join(left, right, ["k"], "ts", 21600, allow_exact=False).collect()}
    assert strict[4] is None and strict[1] == 11


def test_history_ignores_present_and_future_labels(skewed):
    """Flipping a label at or after a row's time must not change that row's features."""
    cut = T0 + dt.timedelta(days=2)
    flipped = skewed.withColumn("hit", F.when(F.col("ts") >= F.lit(cut), ~F.col("hit")).otherwise(F.col("hit")))

    def features(df):
        hit = F.col("hit")
        out = windows.trailing_stats(df, ["key"], "ts", -86400, -1, {"a": ("count", F.when(hit, 1))})
        out = windows.so_far_today(out, ["key"], "ts", hit, ["id"])
        out = windows.recency(out, ["key"], "ts", hit, ["id"])
        out = windows.prior_period_rate(out, ["key"], "ts", hit, "prior")
        out = windows.cutoff_frozen_history(out, ["key"], "ts", "2024-01-03", 30, hit, "frozen")
        return rows_of(out, "a", "prior_positives", "days_since", "prior", "frozen")

    a, b = features(skewed), features(flipped)
    before = [r["id"] for r in skewed.filter(F.col("ts") < F.lit(cut)).collect()]
    assert all(a[i] == b[i] for i in before)
    later = [r["id"] for r in skewed.filter(F.col("ts") >= F.lit(cut)).collect()]
    assert all(a[i][4] == b[i][4] for i in later)  # the frozen feature never sees the flipped labels


def test_order_and_layout_do_not_matter(skewed):
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", "value")}
    one = frames.tick_frame(skewed, ["key"], frames.seconds("ts"), -3600, -1, aggs)
    two = frames.tick_frame(skewed.repartition(7, "value").orderBy(F.rand(5)), ["key"], frames.seconds("ts"), -3600, -1, aggs)
    assert rows_of(one, "n", "s") == rows_of(two, "n", "s")
