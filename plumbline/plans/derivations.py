"""Scalar derivations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derive as fd
from ..operators.joins import dealt_pairs, holiday_window
from .registry import load, query

# hhmm clocks written the same way in both engines; hour 24 is not a valid clock.
DEP = "CAST(floor(o_totalprice) AS BIGINT) % 25 * 100 + CAST(floor(o_totalprice) AS BIGINT) % 60"
ARR = "CAST(floor(o_totalprice * 3) AS BIGINT) % 24 * 100 + CAST(floor(o_totalprice) AS BIGINT) % 59"


@query("hhmm_to_ts", f"""
SELECT o_orderkey, CASE WHEN hhmm // 100 < 24 THEN o_orderdate + to_hours(hhmm // 100) + to_minutes(hhmm % 100)
  END AS departs FROM (SELECT o_orderkey, o_orderdate, {DEP} AS hhmm FROM orders)
""")
def _(spark, d):
    t = load(spark, d, "orders")
    ts = fd.hhmm_to_ts(F.col("o_orderdate"), F.expr(DEP))
    return t.select("o_orderkey", ts.cast("timestamp_ntz").alias("departs"))


@query("local_to_utc", """
SELECT o_orderkey, o_orderdate - INTERVAL 2 HOURS - CASE n_regionkey WHEN 0 THEN INTERVAL 1 HOUR
  WHEN 1 THEN INTERVAL '-7 hours' WHEN 2 THEN INTERVAL 9 HOURS WHEN 3 THEN INTERVAL 0 HOURS
  ELSE INTERVAL '330 minutes' END AS utc
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def _(spark, d):
    zone = F.expr(
        "CASE n_regionkey WHEN 0 THEN 'Africa/Lagos' WHEN 1 THEN 'America/Phoenix'"
        " WHEN 2 THEN 'Asia/Tokyo' WHEN 3 THEN 'UTC' ELSE 'Asia/Kolkata' END"
    )
    t = (
        load(spark, d, "orders")
        .join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("zone", zone)
    )
    utc = fd.local_to_utc(F.col("o_orderdate"), F.col("zone"))
    return t.select("o_orderkey", utc.cast("timestamp_ntz").alias("utc"))


@query("natural_key", """
SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS row_key FROM lineitem
""")
def _(spark, d):
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    return load(spark, d, "lineitem").select(fd.natural_key(*map(F.col, parts)).alias("row_key"))


@query("hhmm_duration", f"""
SELECT o_orderkey, CAST(((arr // 100 * 60 + arr % 100) - (dep // 100 * 60 + dep % 100) + 2880) % 1440 AS INTEGER)
  AS minutes FROM (SELECT o_orderkey, {DEP} AS dep, {ARR} AS arr FROM orders)
""")
def _(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", fd.hhmm_duration(F.expr(DEP), F.expr(ARR)).alias("minutes")
    )


@query("calendar_parts", """
SELECT event_id, CAST(h AS INTEGER) AS hour, CAST(m AS INTEGER) AS month, CAST(w + 1 AS INTEGER) AS weekday,
  (w IN (0, 6))::INT AS is_weekend,
  CASE WHEN m IN (12, 1, 2) THEN 'Winter' WHEN m <= 5 THEN 'Spring' WHEN m <= 8 THEN 'Summer' ELSE 'Fall' END AS season,
  (h BETWEEN 6 AND 9 OR h BETWEEN 17 AND 20)::INT AS is_peak_hour, (m IN (6, 7, 8, 12))::INT AS is_peak_month,
  (h BETWEEN 6 AND 22)::INT AS is_business_hours, (m IN (11, 12, 1))::INT AS is_holiday_month
FROM (SELECT event_id, hour(ts) AS h, month(ts) AS m, dayofweek(ts) AS w FROM events)
""")
def _(spark, d):
    parts = fd.calendar_parts(F.col("ts"))
    return load(spark, d, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("day_part_flags", """
SELECT event_id, (h BETWEEN 5 AND 8)::INT AS is_early_morning, (h BETWEEN 9 AND 11)::INT AS is_morning,
  (h BETWEEN 12 AND 17)::INT AS is_afternoon, (h BETWEEN 18 AND 22)::INT AS is_evening,
  (h < 5 OR h > 22)::INT AS is_night, (w + 1) || '_' || h AS day_hour
FROM (SELECT event_id, hour(ts) AS h, dayofweek(ts) AS w FROM events)
""")
def _(spark, d):
    flags = fd.day_part_flags(F.col("ts"))
    return load(spark, d, "events").select("event_id", *[c.alias(n) for n, c in flags.items()])


@query("cyclic_encode", f"""
SELECT o_orderkey, round(sin(radians(hhmm / 2400.0::DOUBLE * 360)), 6) + 0 AS time_sin,
  round(cos(radians(hhmm / 2400.0::DOUBLE * 360)), 6) + 0 AS time_cos,
  round(sin(radians((month(o_orderdate) - 1) / 12.0::DOUBLE * 360)), 6) + 0 AS month_sin,
  round(cos(radians((month(o_orderdate) - 1) / 12.0::DOUBLE * 360)), 6) + 0 AS month_cos
FROM (SELECT o_orderkey, o_orderdate, {DEP} AS hhmm FROM orders)
""")
def _(spark, d):
    t_sin, t_cos = fd.cyclic_encode(F.expr(DEP), 2400)
    m_sin, m_cos = fd.cyclic_encode(F.month("o_orderdate"), 12, origin=1)
    named = {"time_sin": t_sin, "time_cos": t_cos, "month_sin": m_sin, "month_cos": m_cos}
    return load(spark, d, "orders").select(
        "o_orderkey", *[(F.round(c, 6) + 0).alias(n) for n, c in named.items()]
    )


HOLIDAYS = [f"{y}-{md}" for y in range(1995, 2002) for md in ("01-01", "07-04", "12-25")]


@query("holiday_window", f"""
SELECT o_orderkey, (EXISTS (SELECT 1 FROM (SELECT unnest({HOLIDAYS})::DATE AS h)
  WHERE abs(date_diff('day', h, CAST(o_orderdate AS DATE))) <= 3))::INT AS is_holiday_window FROM orders
""")
def _(spark, d):
    return holiday_window(load(spark, d, "orders"), "o_orderdate", HOLIDAYS, 3, "is_holiday_window").select(
        "o_orderkey", "is_holiday_window"
    )


@query("band", """
SELECT l_returnflag, CASE WHEN l_extendedprice < 20000 THEN 'short' WHEN l_extendedprice < 40000 THEN 'medium'
  WHEN l_extendedprice < 80000 THEN 'long' ELSE 'very long' END AS size,
  CASE WHEN l_quantity <= 10 THEN 'low' WHEN l_quantity <= 30 THEN 'mid' ELSE 'high' END AS level, count(*) AS n
FROM lineitem GROUP BY ALL
""")
def _(spark, d):
    size = fd.band(F.col("l_extendedprice"), [20000, 40000, 80000], ["short", "medium", "long", "very long"])
    level = fd.band(F.col("l_quantity"), [10, 30], ["low", "mid", "high"], right_closed=True)
    return load(spark, d, "lineitem").groupBy("l_returnflag", size.alias("size"), level.alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("fixed_width_bin", """
SELECT floor(l_extendedprice / 2500.0) * 2500.0::DOUBLE AS price_bin, count(*) AS n FROM lineitem GROUP BY 1
""")
def _(spark, d):
    b = fd.fixed_width_bin(F.col("l_extendedprice"), 2500.0)
    return load(spark, d, "lineitem").groupBy(b.cast("double").alias("price_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("severity_index", """
WITH t AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN value / 10 END AS w,
  CASE WHEN event_type <> 'click' THEN value / 200 END AS r,
  CASE WHEN event_type <> 'error' THEN greatest(10 - value / 15, 0) END AS v FROM events)
SELECT event_id, round(coalesce(w, 0) + coalesce(r, 0) * 10 + (10 - coalesce(v, 10)), 6) AS severity,
  CASE WHEN coalesce(v, 10) < 3 OR coalesce(w, 0) > 25 OR coalesce(r, 0) > 0.5 THEN 'Severe'
   WHEN coalesce(v, 10) < 7 OR coalesce(w, 0) > 15 OR coalesce(r, 0) > 0.1 THEN 'Moderate' ELSE 'Clear' END AS class
FROM t
""")
def _(spark, d):
    x = F.col("value")
    wind = F.when(F.col("event_type") != "view", x / 10)
    rain = F.when(F.col("event_type") != "click", x / 200)
    sight = F.when(F.col("event_type") != "error", F.greatest(10 - x / 15, F.lit(0)))
    return load(spark, d, "events").select(
        "event_id",
        F.round(fd.severity_index(wind, rain, sight), 6).alias("severity"),
        fd.severity_class(wind, rain, sight).alias("class"),
    )


@query("keyword_category", """
SELECT doc_id, CASE WHEN text LIKE '%license%' THEN 'legal' WHEN text LIKE '%@%' THEN 'contact'
  WHEN text LIKE '%http%' THEN 'web' ELSE 'Unknown' END AS category,
  concat_ws(',', CASE WHEN contains(lower(text), '@') THEN 'contact' END,
   CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' END,
   CASE WHEN contains(lower(text), 'http') OR contains(lower(text), 'www') THEN 'web' END) AS labels
FROM documents
""")
def _(spark, d):
    rules = {"%license%": "legal", "%@%": "contact", "%http%": "web"}
    words = {"contact": ["@"], "legal": ["license", "copyright"], "web": ["http", "www"]}
    return load(spark, d, "documents").select(
        "doc_id",
        fd.keyword_category(F.col("text"), rules).alias("category"),
        F.concat_ws(",", fd.keyword_labels(F.col("text"), words)).alias("labels"),
    )


@query("category_map", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'industrial'
  WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'home' ELSE 'Other' END AS grp FROM customer
""")
def _(spark, d):
    groups = {"industrial": ["AUTOMOBILE", "MACHINERY"], "home": ["FURNITURE", "HOUSEHOLD"]}
    return load(spark, d, "customer").select(
        "c_custkey", fd.category_map(F.col("c_mktsegment"), groups).alias("grp")
    )


@query("interactions", """
SELECT event_id, round(value * user_id, 6) AS value_x_user, round(value * value, 6) AS value_sq,
  round(exp(-value / 24.0), 6) AS decay FROM events
""")
def _(spark, d):
    x, u = F.col("value"), F.col("user_id")
    named = fd.interactions({"value_x_user": (x, u)}, {"value_sq": x}, {"decay": (x, 24)})
    return load(spark, d, "events").select("event_id", *[F.round(c, 6).alias(n) for n, c in named.items()])


@query("heat_index", """
SELECT event_id, round(CASE WHEN value > 70 THEN value + (user_id - 50) * 0.1::DOUBLE ELSE value END, 6) AS felt
FROM events
""")
def _(spark, d):
    return load(spark, d, "events").select(
        "event_id", F.round(fd.heat_index(F.col("value"), F.col("user_id")), 6).alias("felt")
    )


@query("haversine_km", """
SELECT s_suppkey, c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(lat2) - radians(lat1)) / 2), 2)
  + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))), 3) AS km
FROM (SELECT s_suppkey, c_custkey, s_acctbal / 120 AS lat1, s_suppkey % 180 AS lon1,
  c_acctbal / 120 AS lat2, -(c_custkey % 180) AS lon2
  FROM supplier JOIN customer ON s_nationkey = c_nationkey)
""")
def _(spark, d):
    sites = load(spark, d, "supplier").select(
        "s_suppkey", "s_nationkey", (F.col("s_acctbal") / 120).alias("lat1"), (F.col("s_suppkey") % 180).alias("lon1")
    )
    homes = load(spark, d, "customer").select(
        "c_custkey", "c_nationkey", (F.col("c_acctbal") / 120).alias("lat2"), (-(F.col("c_custkey") % 180)).alias("lon2")
    )
    pairs = dealt_pairs(sites, homes, "s_nationkey", "c_nationkey")
    km = fd.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return pairs.select("s_suppkey", "c_custkey", fd.round_fast(km, 3).alias("km"))


@query("unit_sphere", """
SELECT c_custkey, round(cos(p) * cos(q), 6) + 0 AS x, round(cos(p) * sin(q), 6) + 0 AS y, round(sin(p), 6) + 0 AS z
FROM (SELECT c_custkey, radians(c_acctbal / 120) AS p, radians(c_custkey % 180) AS q FROM customer)
""")
def _(spark, d):
    x, y, z = fd.unit_sphere(F.col("c_acctbal") / 120, F.col("c_custkey") % 180)
    named = {"x": x, "y": y, "z": z}
    return load(spark, d, "customer").select(
        "c_custkey", *[(F.round(c, 6) + 0).alias(n) for n, c in named.items()]
    )


@query("parse_coordinates", """
SELECT s_suppkey, CASE WHEN s_nationkey <> 3 THEN s_acctbal END AS lat, CAST(s_suppkey AS DOUBLE) AS lon FROM supplier
""")
def _(spark, d):
    text = F.concat(
        F.col("s_suppkey").cast("string"),
        F.lit(", "),
        F.when(F.col("s_nationkey") == 3, "n/a").otherwise(F.col("s_acctbal").cast("string")),
    )
    lat, lon = fd.parse_coordinates(text)
    return load(spark, d, "supplier").select("s_suppkey", lat.alias("lat"), lon.alias("lon"))


@query("session_clock", """
SELECT event_id, greatest(m - 570, 0)::INT AS minutes_from_open, greatest(960 - m, 0)::INT AS minutes_to_close,
  round((m - 570) / 390.0::DOUBLE, 6) AS session_progress
FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, ts FROM events)
WHERE hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) BETWEEN 34200 AND 57600
""")
def _(spark, d):
    clock = fd.session_clock(F.col("ts"))
    clock["session_progress"] = F.round(clock["session_progress"], 6)
    return load(spark, d, "events").filter(fd.in_session(F.col("ts"))).select(
        "event_id", *[c.alias(n) for n, c in clock.items()]
    )
