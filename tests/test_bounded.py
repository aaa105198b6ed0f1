"""Crowded buckets are cut until no window partition holds more rows than the limit, and results stay exact."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators import frames, joins, quantiles, sampling, windows


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(frames, "BUCKET_ROWS", 50)


def largest(df, keys, bucket, order):
    cut = frames.bounded_buckets(df.withColumn("_b", bucket), keys, order, "_b")
    return cut, cut.groupBy(*keys, "_b").count().agg(F.max("count")).first()[0]


@pytest.fixture(scope="module")
def crowded(spark):
    """Nine tenths of the rows in one key and one day, half of those in one second."""
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.9
        at = 1_700_000_000 + (7200 + rng.random() if rng.random() < 0.5 else rng.random() * 86400 * (1 if hot else 30))
        rows.append((i, "hot" if hot else f"k{i % 7}", at, rng.random() < 0.3, None if rng.random() < 0.1 else round(rng.random(), 3)))
    df = spark.createDataFrame(rows, "id long, key string, sec double, hit boolean, value double")
    return df.withColumn("ts", F.timestamp_micros((F.col("sec") * 1000000).cast("long"))).cache()


def test_no_part_is_larger_than_the_limit(crowded, small):
    cut, most = largest(crowded, ["key"], windows._day_bucket("ts"), [frames.micros("ts"), F.col("id")])
    assert most <= 50
    w = W.partitionBy("key").orderBy("_b")
    spans = cut.groupBy("key", "_b").agg(F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("z"))
    assert spans.withColumn("before", F.lag("z").over(w)).filter("before >= a").isEmpty()


def test_ties_go_on_with_the_next_column_and_odd_values_keep_their_place(spark, small):
    rows = [(1, v, i) for i in range(90) for v in (1.5, None, float("nan"), float("inf"), float("-inf"), -1e308, 1e308)]
    df = spark.createDataFrame(rows, "k int, v double, i long")
    cut, most = largest(df, ["k"], F.lit(0), [F.col("v"), F.col("i")])
    assert most <= 50
    got = frames.number_rows(df, ["k"], F.lit(0), [F.col("v"), F.col("i")], "n")
    want = df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("v", "i")))
    pick = lambda d: sorted((str(r.v), r.i, r.n) for r in d.collect())
    assert pick(got) == pick(want)


@pytest.mark.parametrize("current", [True, False])
def test_running_over_cut_buckets(crowded, small, current):
    specs = {"n": ("count", "value"), "s": ("sum", "value"), "hi": ("max", "value"), "last": ("last", "value")}
    got = frames.running(crowded, ["key"], windows._day_bucket("ts"), [frames.micros("ts"), F.col("id")], specs, current)
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0 if current else -1)
    want = crowded.select("id", F.count("value").over(w), F.sum("value").over(w), F.max("value").over(w), F.last("value", True).over(w))
    plain = lambda rows: sorted(tuple(x if x is None else round(x, 6) for x in r) for r in rows)
    assert plain(got.select("id", *specs).collect()) == plain(want.collect())


def test_row_frame_previous_event_and_folds(crowded, small):
    got = windows.previous_event(crowded, ["key"], "ts", {"before": "id"}, ["id"])
    want = crowded.withColumn("before", F.lag("id").over(W.partitionBy("key").orderBy("ts", "id")))
    assert {tuple(r) for r in got.select("id", "before").collect()} == {tuple(r) for r in want.select("id", "before").collect()}
    folds = sampling.stratified_folds(crowded, "hit", ["id"], 5).groupBy("hit", "fold").count().groupBy("hit").agg(
        (F.max("count") - F.min("count")).alias("d"))
    assert all(r.d <= 1 for r in folds.collect())


def test_asof_join_with_a_crowded_day_and_null_rows(spark, crowded, small):
    left = crowded.select("id", "key", "ts").unionByName(spark.createDataFrame([(-1, None, None), (-2, "hot", None)], "id long, key string, ts timestamp"))
    right = crowded.filter("hit").select("key", "ts", F.col("id").alias("o"))
    got = joins.asof_join(left, right, ["key"], "ts", allow_exact=False).select("id", "r_o").collect()
    rows = right.collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.key, []).append((r.ts, r.o))
    best = {}
    for r in left.collect():
        seen = [x for x in by_key.get(r.key, []) if r.ts is not None and x[0] < r.ts]
        best[r.id] = max(seen)[1] if seen else None
    assert {r.id: r.r_o for r in got} == best


def test_quantiles_of_values_far_from_zero(spark, small):
    rng = random.Random(9)
    values = [1.7e9 + rng.random() for _ in range(4000)] + [1.7e9 + 0.25] * 500 + [-1e18, 3.0]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double")
    assert df.filter("v > 4").groupBy(quantiles.value_bucket(F.col("v"))).count().count() == 1  # all in one bucket
    got = {(r.g, r.prob): r.quantile for r in quantiles.exact_quantiles(df, ["g"], ["v"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for g in range(3):
        mine = sorted(v for i, v in enumerate(values) if i % 3 == g)
        for p in (0.0, 0.1, 0.5, 0.99, 1.0):
            at = p * (len(mine) - 1)
            lo = mine[int(at)]
            hi = mine[min(int(at) + (at > int(at)), len(mine) - 1)]
            assert got[(g, p)] == pytest.approx(lo + (hi - lo) * (at - int(at)), rel=1e-15)
    _, most = largest(df.groupBy("g", "v").count(), ["g"], quantiles.value_bucket(F.col("v")), [F.col("v")])
    assert most <= 50
    ranks = quantiles.average_ranks(df, ["g"], "v", "r").groupBy("g").agg(F.sum("r").alias("s"), F.count("r").alias("n"))
    assert all(r.s == r.n * (r.n + 1) / 2 for r in ranks.collect())
    assert statistics.median(values) > 1.7e9
