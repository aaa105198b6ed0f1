"""History features, bars and cross-sections on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derive as fd
from ..operators import bars as b
from ..operators import report as r
from ..operators import windows as w
from ..operators.joins import asof_join
from .registry import load, query
from .reporting import rounded

SEC = "epoch_us(ts) // 1000000"
DAYNO = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"


def _events(spark, d):
    return load(spark, d, "events")


TRAIL_SQL = f"""
SELECT event_id, n, errors, round(errors::DOUBLE / nullif(n, 0), 6) AS error_rate, round(mean, 6) AS mean, round(std, 4) AS std
FROM (SELECT event_id, count(*) OVER f AS n, count(*) FILTER (event_type = 'error') OVER f AS errors,
   avg(value) OVER f AS mean, stddev_samp(value) OVER f AS std
 FROM (SELECT *, {SEC} AS s FROM events)
 WINDOW f AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 7200 PRECEDING))
"""


def _trailing(spark, d):
    aggs = {
        "n": ("count", F.lit(1)),
        "errors": ("count", F.when(F.col("event_type") == "error", 1)),
        "mean": ("avg", "value"),
        "std": ("std", "value"),
    }
    return w.trailing_stats(
        _events(spark, d), ["user_id"], "ts", -86400, -7200, aggs, {"error_rate": ("errors", "n")}
    )


@query("trailing_stats", TRAIL_SQL)
def _(spark, d):
    out = _trailing(spark, d).select("event_id", "n", "errors", "error_rate", "mean", "std")
    return rounded(rounded(out, "error_rate", "mean", places=6), "std")


@query("trailing_stats_two_keys", f"""
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY {SEC}
  RANGE BETWEEN 86400 PRECEDING AND 100 PRECEDING), 6) AS mean FROM events
""")
def _(spark, d):
    out = w.trailing_stats(
        _events(spark, d), ["user_id", "event_type"], "ts", -86400, -100, {"mean": ("avg", "value")}
    )
    return rounded(out.select("event_id", "mean"), "mean", places=6)


@query("trailing_days", f"""
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY {DAYNO} RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS volume,
 round(coalesce(avg((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey ORDER BY {DAYNO} RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING),
  avg((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey), 0.21), 6) AS rate FROM orders
""")
def _(spark, d):
    t = load(spark, d, "orders").withColumn("late", (F.col("o_orderstatus") == "F").cast("double"))
    out = w.trailing_days(t, ["o_custkey"], "o_orderdate", 365, "count", F.lit(1), "volume")
    out = w.trailing_days(out, ["o_custkey"], "o_orderdate", 365, "avg", "late", "rate")
    return rounded(out.select("o_orderkey", "volume", "rate"), "rate", places=6)


@query("prior_period_rate", f"""
WITH t AS (SELECT o_orderpriority, {DAYNO} AS day, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY 1, 2),
p AS (SELECT *, lag(rate) OVER (PARTITION BY o_orderpriority ORDER BY day) AS prior FROM t)
SELECT o_orderkey, round(coalesce(prior, 0.21), 6) AS prior_rate FROM orders o JOIN p
 ON o.o_orderpriority = p.o_orderpriority AND {DAYNO} = p.day
""")
def _(spark, d):
    out = w.prior_period_rate(
        load(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", F.col("o_orderstatus") == "F", "prior_rate"
    )
    return rounded(out.select("o_orderkey", "prior_rate"), "prior_rate", places=6)


@query("so_far_today", """
SELECT event_id, prior_rows, prior_positives, round((prior_positives + 0.5) / (prior_rows + 1), 6) AS prior_ratio
FROM (SELECT event_id, count(*) OVER f AS prior_rows, count(*) FILTER (event_type = 'error') OVER f AS prior_positives FROM events
 WINDOW f AS (PARTITION BY event_type IN ('error', 'view'), CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""")
def _(spark, d):
    t = _events(spark, d).withColumn("grp", F.col("event_type").isin("error", "view"))
    out = w.so_far_today(t, ["grp"], "ts", F.col("event_type") == "error", ["event_id"])
    return rounded(out.select("event_id", "prior_rows", "prior_positives", "prior_ratio"), "prior_ratio", places=6)


@query("history_ratio", """
SELECT event_id, round(m, 6) AS history_mean, round(CASE WHEN m > 0 THEN value / m ELSE 1 END, 6) AS history_ratio
FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type, dayofweek(ts) ORDER BY ts, event_id
  ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM events)
""")
def _(spark, d):
    t = _events(spark, d).withColumn("dow", F.dayofweek("ts"))
    out = w.history_ratio(t, ["event_type", "dow"], "ts", "value", ["event_id"], 20)
    return rounded(out.select("event_id", "history_mean", "history_ratio"), "history_mean", "history_ratio", places=6)


@query("previous_event", """
WITH t AS (SELECT event_id, lag(value) OVER f AS v, lag((event_type = 'error')::DOUBLE) OVER f AS e,
  (epoch_us(ts) - epoch_us(lag(ts) OVER f)) / 3.6e9 AS h FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, (h IS NULL)::INT AS is_first, round(coalesce(v, (SELECT avg(v) FROM t)), 6) AS prev_value,
 round(coalesce(e, (SELECT avg(e) FROM t)), 6) AS prev_error, round(coalesce(h, (SELECT avg(h) FROM t)), 6) AS hours_since_prev FROM t
""")
def _(spark, d):
    t = _events(spark, d).withColumn("err", (F.col("event_type") == "error").cast("double"))
    out = w.previous_event_features(
        t, ["user_id"], "ts", {"prev_value": "value", "prev_error": "err"}, ["event_id"]
    )
    out = out.select("event_id", "is_first", "prev_value", "prev_error", "hours_since_prev")
    return rounded(out, "prev_value", "prev_error", "hours_since_prev", places=6)


@query("recency", f"""
WITH t AS (SELECT o_orderkey, o_custkey, {DAYNO} AS day, CASE WHEN o_orderstatus = 'F' THEN {DAYNO} END AS hit FROM orders)
SELECT o_orderkey, CAST(coalesce(day - max(hit) OVER (PARTITION BY o_custkey ORDER BY day
  RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS INTEGER) AS days_since FROM t
""")
def _(spark, d):
    out = w.recency(
        load(spark, d, "orders"), ["o_custkey"], "o_orderdate", F.col("o_orderstatus") == "F", ["o_orderkey"]
    )
    return out.select("o_orderkey", "days_since")


@query("frequency", f"""
SELECT o_orderkey, n AS events, p AS positives, round(p::DOUBLE / nullif(n, 0), 6) AS rate FROM (
 SELECT o_orderkey, count(*) OVER f AS n, count(*) FILTER (o_orderstatus = 'F') OVER f AS p FROM (SELECT *, {DAYNO} AS day FROM orders)
 WINDOW f AS (PARTITION BY o_orderpriority ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
""")
def _(spark, d):
    out = w.frequency(load(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", F.col("o_orderstatus") == "F")
    return rounded(out.select("o_orderkey", "events", "positives", "rate"), "rate", places=6)


@query("magnitude", f"""
SELECT o_orderkey, round(avg(hit) OVER f, 7) AS avg_size, max(hit) OVER f AS max_size FROM (
 SELECT *, {DAYNO} AS day, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS hit FROM orders)
WINDOW f AS (PARTITION BY o_orderpriority ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)
""")
def _(spark, d):
    out = w.magnitude(
        load(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", F.col("o_orderstatus") == "F", "o_totalprice"
    )
    return rounded(out.select("o_orderkey", "avg_size", "max_size"), "avg_size", places=7)


def _congestion_sql(hi):
    return f"""
SELECT event_id, count(*) FILTER (event_type = 'error') OVER f AS errors, count(*) FILTER (value > 100) OVER f AS large
FROM (SELECT *, {SEC} AS s FROM events)
WINDOW f AS (PARTITION BY event_type IN ('error', 'view') ORDER BY s RANGE BETWEEN 7200 PRECEDING AND {hi})"""


def _congestion(spark, d, include):
    t = _events(spark, d).withColumn("grp", F.col("event_type").isin("error", "view"))
    flags = {"errors": F.col("event_type") == "error", "large": F.col("value") > 100}
    return w.congestion(t, ["grp"], "ts", flags, include_current=include).select("event_id", "errors", "large")


query("congestion", _congestion_sql("1 PRECEDING"))(lambda spark, d: _congestion(spark, d, False))
query("congestion_inclusive", _congestion_sql("CURRENT ROW"))(lambda spark, d: _congestion(spark, d, True))


@query("swing", """
SELECT event_id, round(s, 6) AS value_swing, (s > 120)::INT AS rapid_change FROM (SELECT event_id, max(value) OVER f - min(value) OVER f AS s
 FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
""")
def _(spark, d):
    out = w.swing(_events(spark, d), ["user_id"], "ts", {"value": 120}, ["event_id"])
    return rounded(out.select("event_id", "value_swing", "rapid_change"), "value_swing", places=6)


@query("swing_time", f"""
SELECT event_id, round(s, 6) AS value_swing, (s > 120)::INT AS rapid_change FROM (SELECT event_id, max(value) OVER f - min(value) OVER f AS s
 FROM (SELECT *, {SEC} AS sec FROM events) WINDOW f AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 10800 PRECEDING AND CURRENT ROW))
""")
def _(spark, d):
    out = w.swing_time(_events(spark, d), ["user_id"], "ts", {"value": 120}, 10800)
    return rounded(out.select("event_id", "value_swing", "rapid_change"), "value_swing", places=6)


@query("anomaly", """
SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id, month(ts)), 8) AS value_anomaly FROM events
""")
def _(spark, d):
    t = _events(spark, d).withColumn("month", F.month("ts"))
    out = w.anomaly(t, ["user_id", "month"], ["value"])
    return rounded(out.select("event_id", "value_anomaly"), "value_anomaly", places=8)


@query("group_share", """
SELECT event_id, round(count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE), hour(ts))::DOUBLE
 / (count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)) + 1), 6) AS density FROM events
""")
def _(spark, d):
    t = _events(spark, d).withColumns({"day": F.col("ts").cast("date"), "hour": F.hour("ts")})
    out = w.group_share(t, ["event_type", "day"], ["event_type", "day", "hour"], "density")
    return rounded(out.select("event_id", "density"), "density", places=6)


CUT = "1999-01-01"
FROZEN_SQL = f"""
WITH t AS (SELECT o_orderkey, o_custkey, o_orderdate, {DAYNO} AS day, (o_orderstatus = 'F')::DOUBLE AS y FROM orders),
c AS (SELECT CAST(date_diff('day', DATE '1970-01-01', DATE '{CUT}') AS BIGINT) AS cut)
SELECT o_orderkey, o_custkey, o_orderdate, (SELECT avg(h.y) FROM t h WHERE h.o_custkey = t.o_custkey AND h.day < cut
  AND h.day BETWEEN least(t.day, cut) - 365 AND least(t.day, cut) - 1) AS rate FROM t, c
"""


def _frozen(spark, d):
    return w.cutoff_frozen_history(
        load(spark, d, "orders"), ["o_custkey"], "o_orderdate", CUT, 365, F.col("o_orderstatus") == "F", "rate"
    )


@query("cutoff_frozen_history", f"SELECT o_orderkey, round(rate, 6) AS rate FROM ({FROZEN_SQL})")
def _(spark, d):
    return rounded(_frozen(spark, d).select("o_orderkey", "rate"), "rate", places=6)


@query("leakage_audit", f"""
SELECT o_custkey, 'rate' AS feature, round(stddev_samp(rate), 6) AS std, round(min(rate), 6) AS min, round(max(rate), 6) AS max,
  count(rate) AS n FROM ({FROZEN_SQL}) WHERE o_orderdate >= TIMESTAMP '{CUT}' GROUP BY 1
""")
def _(spark, d):
    out = w.leakage_audit(_frozen(spark, d), ["o_custkey"], "o_orderdate", CUT, ["rate"])
    return rounded(out, "std", "min", "max", places=6)


@query("future_rows", """
WITH l AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT user_id, ts AS r_ts FROM events WHERE event_type = 'purchase')
SELECT count(*) FILTER (r_ts > ts) AS future, count(r_ts) AS matched FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.r_ts
""")
def _(spark, d):
    t = _events(spark, d).select("user_id", "ts", "event_type")
    left = t.filter("event_type = 'error'").drop("event_type")
    right = t.filter("event_type = 'purchase'").drop("event_type")
    return w.future_rows(asof_join(left, right, ["user_id"], "ts"), "r_ts", "ts")


# --- bars -------------------------------------------------------------------------------------

BARS = """bars AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTES, ts) AS bar, arg_min(value, ts) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
PRICES = """px AS (SELECT o_orderpriority AS fund, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 8) AS price FROM orders GROUP BY 1, 2)"""


def _bars(spark, d):
    out = b.rebar(_events(spark, d), ["event_type"], "ts", "30 minutes", "value", ties=["event_id"])
    return out.select("event_type", "bar", "open", "high", "low", "close", "volume")


def _prices(spark, d):
    return (
        load(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("fund"), F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.round(F.avg("o_totalprice"), 8).alias("price"))
    )


def _rebar_sql(shift, label):
    return f"""
SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts - INTERVAL {shift} MICROSECONDS) + INTERVAL {label} HOURS AS bar, arg_min(value, ts) AS open,
 max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 4) AS total, round(avg(value), 6) AS mean,
 round(stddev_samp(value), 4) AS std, count(*) AS volume FROM (SELECT user_id, value, date_trunc('minute', ts) + to_microseconds(event_id) AS ts FROM events) GROUP BY 1, 2"""


def _rebar(spark, d, closed, label):
    # Times cut to the minute plus a unique microsecond offset keep window edges populated.
    edge = F.timestamp_micros(
        F.unix_micros(F.date_trunc("minute", F.col("ts").cast("timestamp"))) + F.col("event_id")
    ).cast("timestamp_ntz")
    t = _events(spark, d).withColumn("ts", edge)
    out = b.rebar(t, ["user_id"], "ts", "6 hours", "value", closed=closed, label=label)
    return rounded(rounded(out, "total", "std"), "mean", places=6)


query("rebar", _rebar_sql(0, 0))(lambda spark, d: _rebar(spark, d, "left", "left"))
query("rebar_right_closed", _rebar_sql(1, 6))(lambda spark, d: _rebar(spark, d, "right", "right"))


@query("bar_shape", f"""
WITH {BARS} SELECT event_type, bar, round((high - low) / nullif(close, 0), 6) AS bar_range, round((close - open) / nullif(high - low, 0), 6) AS signed_range,
 round((high - close) / nullif(close, 0), 6) AS upper_wick, round((close - low) / nullif(close, 0), 6) AS lower_wick,
 round((close - low) / nullif(high - low, 0), 6) AS range_position FROM bars
""")
def _(spark, d):
    shape = fd.bar_shape(*(F.col(c) for c in ("open", "high", "low", "close")))
    return _bars(spark, d).select("event_type", "bar", *[F.round(c, 6).alias(n) for n, c in shape.items()])


@query("returns", f"""
WITH {PRICES} SELECT fund, day, round(price / lag(price) OVER f - 1, 6) AS ret, round(ln(price / lag(price) OVER f), 6) AS log_ret,
 round(price / lag(price, 5) OVER f - 1, 6) AS ret_5, round(ln(price / lag(price, 5) OVER f), 6) AS log_ret_5
FROM px WINDOW f AS (PARTITION BY fund ORDER BY day)
""")
def _(spark, d):
    out = b.returns(_prices(spark, d), ["fund"], "day", "price")
    out = b.returns(out, ["fund"], "day", "price", 5, names=("ret_5", "log_ret_5")).drop("price")
    return rounded(out, "ret", "log_ret", "ret_5", "log_ret_5", places=6)


@query("returns_within_day", f"""
WITH {BARS} SELECT event_type, bar, round(close / lag(close) OVER f - 1, 6) AS ret, round(ln(close / lag(close) OVER f), 6) AS log_ret
FROM bars WINDOW f AS (PARTITION BY event_type, CAST(bar AS DATE) ORDER BY bar)
""")
def _(spark, d):
    out = b.returns(_bars(spark, d), ["event_type"], "bar", "close", within_day=True)
    return rounded(out.select("event_type", "bar", "ret", "log_ret"), "ret", "log_ret", places=6)


@query("volume_change", f"""
WITH {BARS} SELECT event_type, bar, round(coalesce(volume::DOUBLE / nullif(lag(volume) OVER (PARTITION BY event_type ORDER BY bar), 0), 0), 6) AS vol_change FROM bars
""")
def _(spark, d):
    out = b.volume_change(_bars(spark, d), ["event_type"], "bar", "volume")
    return rounded(out.select("event_type", "bar", "vol_change"), "vol_change", places=6)


@query("rolling", f"""
WITH {BARS} SELECT event_type, bar, round(CASE WHEN count(close) OVER f >= 3 THEN avg(close) OVER f END, 6) AS mean_5,
 round(CASE WHEN count(close) OVER f >= 3 THEN stddev_samp(close) OVER f END, 4) AS std_5,
 round(volume / nullif(CASE WHEN count(volume) OVER f >= 3 THEN avg(volume) OVER f END, 0), 6) AS volume_ratio
FROM bars WINDOW f AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")
def _(spark, d):
    specs = {
        "mean_5": ("mean", "close", 5, 3), "std_5": ("std", "close", 5, 3), "vol_5": ("mean", "volume", 5, 3),
    }
    out = b.rolling(_bars(spark, d), ["event_type"], "bar", specs, {"volume_ratio": ("volume", "vol_5")})
    out = out.select("event_type", "bar", "mean_5", "std_5", "volume_ratio")
    return rounded(rounded(out, "mean_5", "volume_ratio", places=6), "std_5")


@query("rolling_z", f"""
WITH {BARS}, s AS (SELECT *, stddev_samp(close) OVER a AS sa, stddev_samp(close) OVER p AS sp, count(close) OVER a AS na, count(close) OVER p AS np,
 avg(close) OVER z AS mz, stddev_samp(close) OVER z AS sz, count(close) OVER z AS nz FROM bars
 WINDOW a AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
  p AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 23 PRECEDING AND 12 PRECEDING),
  z AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_type, bar, round(CASE WHEN nz >= 20 THEN (close - mz) / nullif(sz, 0) END, 5) AS z,
 round(CASE WHEN na >= 12 AND np >= 12 THEN sa / nullif(sp, 0) END, 5) AS burst FROM s
""")
def _(spark, d):
    out = b.rolling_z(_bars(spark, d), ["event_type"], "bar", "close", 20, "z")
    out = b.volatility_burst(out, ["event_type"], "bar", "close", 12, "burst")
    return rounded(out.select("event_type", "bar", "z", "burst"), "z", "burst", places=5)


@query("moving_averages", f"""
WITH {PRICES} SELECT fund, day, {', '.join(f"round(CASE WHEN count(*) OVER w{n} >= {n} THEN avg(price) OVER w{n} END, 8) AS ma_{n}" for n in (5, 10, 20))}
FROM px WINDOW {', '.join(f"w{n} AS (PARTITION BY fund ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10, 20))}
""")
def _(spark, d):
    out = b.moving_averages(_prices(spark, d), ["fund"], "day", "price").drop("price")
    return rounded(out, "ma_5", "ma_10", "ma_20", places=8)


@query("gap_return", f"""
WITH {BARS} SELECT event_type, bar, round((open - lag(close) OVER f) / nullif(lag(close) OVER f, 0), 6) AS gap_return
FROM bars WINDOW f AS (PARTITION BY event_type ORDER BY bar)
""")
def _(spark, d):
    out = b.gap_return(_bars(spark, d), ["event_type"], "bar").select("event_type", "bar", "gap_return")
    return rounded(out, "gap_return", places=6)


@query("session_vwap", f"""
WITH {BARS}, v AS (SELECT *, sum(close * volume) OVER f / nullif(sum(volume) OVER f, 0) AS vw FROM bars
 WINDOW f AS (PARTITION BY event_type, CAST(bar AS DATE) ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_type, bar, round(vw, 8) AS vwap, round((close - vw) / nullif(vw, 0), 6) AS vwap_distance FROM v
""")
def _(spark, d):
    out = b.session_vwap(_bars(spark, d), ["event_type"], "bar").select("event_type", "bar", "vwap", "vwap_distance")
    return rounded(rounded(out, "vwap", places=8), "vwap_distance", places=6)


@query("cross_section_z", f"""
WITH {BARS} SELECT event_type, bar, round((close - avg(close) OVER f) / nullif(stddev_samp(close) OVER f, 0), 5) AS close_z,
 round((volume - avg(volume) OVER f) / nullif(stddev_samp(volume) OVER f, 0), 5) AS volume_z FROM bars WINDOW f AS (PARTITION BY bar)
""")
def _(spark, d):
    out = b.cross_section_z(_bars(spark, d), "bar", ["close", "volume"])
    return rounded(out.select("event_type", "bar", "close_z", "volume_z"), "close_z", "volume_z", places=5)


@query("cross_section_rank", f"""
WITH {BARS} SELECT event_type, bar, round((rank() OVER (PARTITION BY bar ORDER BY volume) + (count(*) OVER (PARTITION BY bar, volume) - 1) / 2.0::DOUBLE)
 / count(*) OVER (PARTITION BY bar), 6) AS volume_rank FROM bars
""")
def _(spark, d):
    out = b.cross_section_rank(_bars(spark, d), "bar", "volume", "volume_rank")
    return rounded(out.select("event_type", "bar", "volume_rank"), "volume_rank", places=6)


@query("sector_relative", f"""
WITH {BARS}, s AS (SELECT *, event_type IN ('error', 'view') AS sector FROM bars)
SELECT event_type, bar, round(close - avg(close) OVER f, 5) AS close_vs_sector,
 round((close - avg(close) OVER f) / nullif(stddev_samp(close) OVER f, 0), 5) AS close_sector_z FROM s WINDOW f AS (PARTITION BY bar, sector)
""")
def _(spark, d):
    t = _bars(spark, d).withColumn("sector", F.col("event_type").isin("error", "view"))
    out = b.sector_relative(t, "bar", "sector", "close")
    out = out.select("event_type", "bar", "close_vs_sector", "close_sector_z")
    return rounded(out, "close_vs_sector", "close_sector_z", places=5)


@query("forward_target", f"""
WITH {BARS}, t AS (SELECT event_type, bar, lead(close) OVER (PARTITION BY event_type, CAST(bar AS DATE) ORDER BY bar) AS target FROM bars)
SELECT event_type, bar, target, CASE WHEN target IS NOT NULL THEN round((rank() OVER (PARTITION BY bar ORDER BY target NULLS LAST)
  + (count(*) OVER (PARTITION BY bar, target) - 1) / 2.0::DOUBLE) / count(target) OVER (PARTITION BY bar), 6) END AS target_rank FROM t
""")
def _(spark, d):
    out = b.forward_target(_bars(spark, d), ["event_type"], "bar", "close")
    return rounded(out.select("event_type", "bar", "target", "target_rank"), "target_rank", places=6)


FUNDS = f"""WITH {PRICES}, e AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(day) AS a, max(day) AS b FROM px GROUP BY fund)),
c AS (SELECT px.* FROM px, e WHERE day BETWEEN a AND b),
g AS (SELECT fund, day, last_value(price IGNORE NULLS) OVER (PARTITION BY fund ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
  FROM (SELECT DISTINCT day FROM c) CROSS JOIN (SELECT DISTINCT fund FROM c) LEFT JOIN c USING (day, fund))"""


@query("fund_performance", f"""{FUNDS},
r AS (SELECT fund, day, price, price / lag(price) OVER f - 1 AS ret, price / max(price) OVER f - 1 AS dd FROM g WINDOW f AS (PARTITION BY fund ORDER BY day)),
p AS (SELECT fund, arg_max(price, day) / arg_min(price, day) AS growth, stddev_samp(ret) * sqrt(252) AS vol, min(dd) AS dd, count(*) AS n FROM r GROUP BY 1),
s AS (SELECT *, pow(growth, 252.0 / n) - 1 AS annual FROM p)
SELECT fund, round(growth * 100, 4) AS final_value, round((growth - 1) * 100, 4) AS total_return, round(annual * 100, 4) AS annual_return,
 round(vol * 100, 3) AS annual_vol, round(annual / vol, 5) AS sharpe, round(dd * 100, 4) AS max_drawdown,
 CASE WHEN growth = max(growth) OVER () THEN 'best' WHEN growth = min(growth) OVER () THEN 'worst' END AS standing FROM s
""")
def _(spark, d):
    out = b.fund_performance(_prices(spark, d), "fund", "day", "price")
    out = rounded(out, "final_value", "total_return", "annual_return", "max_drawdown")
    return rounded(rounded(out, "annual_vol", places=3), "sharpe", places=5)


@query("fund_curve", f"""
WITH {PRICES}, e AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(day) AS a, max(day) AS b FROM px GROUP BY fund))
SELECT fund, day, round(price / first_value(price) OVER (PARTITION BY fund ORDER BY day) * 100, 5) AS value FROM px, e WHERE day BETWEEN a AND b
""")
def _(spark, d):
    return rounded(b.fund_curve(_prices(spark, d), "fund", "day", "price"), "value", places=5)


# --- flagship ---------------------------------------------------------------------------------


@query("flagship", f"""
WITH h AS (SELECT event_id, user_id, ts, event_type, count(*) OVER f AS n, count(*) FILTER (event_type = 'error') OVER f AS errors
  FROM (SELECT *, {SEC} AS s FROM events)
  WINDOW f AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 7200 PRECEDING)),
p AS (SELECT user_id, ts AS r_ts, value AS r_value FROM events WHERE event_type = 'purchase'),
j AS (SELECT h.*, r_ts, r_value FROM h ASOF LEFT JOIN p ON h.user_id = p.user_id AND h.ts >= p.r_ts),
k AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(r_ts) <= 21600000000 THEN r_value END AS spent, CASE WHEN hour(ts) BETWEEN 5 AND 8 THEN 'early_morning'
  WHEN hour(ts) BETWEEN 9 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS day_part FROM j)
SELECT user_id, day_part, count(*) AS n, count(*) FILTER (event_type = 'error') AS positives,
 round(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 4) AS rate_pct, round(avg(n), 6) AS mean_history,
 round(avg(errors::DOUBLE / nullif(n, 0)), 6) AS mean_history_rate, count(spent) AS after_purchase, round(avg(spent), 6) AS mean_spent FROM k GROUP BY 1, 2
""")
def _(spark, d):
    history = _trailing(spark, d).select(
        "event_id", "user_id", "ts", "event_type", F.col("n").alias("history"), "error_rate"
    )
    bought = _events(spark, d).filter("event_type = 'purchase'").select("user_id", "ts", "value")
    joined = asof_join(history, bought, ["user_id"], "ts", 6 * 3600)
    out = joined.groupBy("user_id", fd.day_part(F.col("ts")).alias("day_part")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "error").alias("positives"),
        F.avg("history").alias("mean_history"),
        F.avg("error_rate").alias("mean_history_rate"),
        F.count("r_value").alias("after_purchase"),
        F.avg("r_value").alias("mean_spent"),
    )
    out = out.withColumn("rate_pct", F.round(F.col("positives") * 100.0 / F.col("n"), 4))
    return rounded(out, "mean_history", "mean_history_rate", "mean_spent", places=6)
