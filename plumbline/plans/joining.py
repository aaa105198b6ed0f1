"""Joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from .registry import load, query

HOURS_6 = 6 * 3600


def _events(spark, d, kind):
    return load(spark, d, "events").filter(F.col("event_type") == kind)


@query("enrich", """
SELECT a.n_name AS origin_n_name, b.n_name AS dest_n_name, a.n_regionkey AS origin_n_regionkey,
  b.n_regionkey AS dest_n_regionkey, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation a ON s_nationkey = a.n_nationkey LEFT JOIN nation b ON c_nationkey = b.n_nationkey
GROUP BY ALL
""")
def _(spark, d):
    routes = (
        load(spark, d, "lineitem")
        .join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    roles = {"s_nationkey": "origin_", "c_nationkey": "dest_"}
    named = j.enrich(routes, load(spark, d, "nation"), "n_nationkey", roles)
    return named.drop("s_nationkey", "c_nationkey")


@query("coalesce_join", """
SELECT c_custkey, coalesce(s_name, n_name) AS label FROM customer
LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def _(spark, d):
    first = load(spark, d, "supplier").withColumnRenamed("s_name", "label")
    second = load(spark, d, "nation").withColumnRenamed("n_name", "label")
    out = j.coalesce_join(
        load(spark, d, "customer"), first, second,
        ("c_custkey", "s_suppkey"), ("c_nationkey", "n_nationkey"), ["label"],
    )
    return out.select("c_custkey", "label")


@query("nearest_k", """
WITH p AS (SELECT c_custkey AS point_id, c_acctbal / 120 AS lat, c_custkey * 7919 % 360 - 180.0::DOUBLE AS lon FROM customer),
s AS (SELECT s_suppkey AS site_id, s_acctbal / 120 AS slat, s_suppkey * 104729 % 360 - 180.0::DOUBLE AS slon FROM supplier),
x AS (SELECT point_id, site_id, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(slat) - radians(lat)) / 2), 2)
  + cos(radians(lat)) * cos(radians(slat)) * pow(sin((radians(slon) - radians(lon)) / 2), 2)))) AS km FROM p, s)
SELECT point_id, site_id, round(km, 3) AS dist_km, CAST(rn AS INTEGER) AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, site_id) AS rn FROM x) WHERE rn <= 3
""")
def _(spark, d):
    points = load(spark, d, "customer").select(
        F.col("c_custkey").alias("point_id"),
        (F.col("c_acctbal") / 120).alias("lat"),
        (F.col("c_custkey") * 7919 % 360 - 180.0).alias("lon"),
    )
    sites = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("site_id"),
        (F.col("s_acctbal") / 120).alias("lat"),
        (F.col("s_suppkey") * 104729 % 360 - 180.0).alias("lon"),
    )
    return j.nearest_k(points, sites, 3).withColumn("dist_km", F.round("dist_km", 3))


ASOF_SQL = """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, ts AS r_ts, event_id AS r_event_id, value AS r_value FROM events WHERE event_type = 'purchase'),
m AS (SELECT l.*, r_ts, r_event_id, r_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.r_ts),
k AS (SELECT *, r_ts IS NOT NULL AND epoch_us(ts) - epoch_us(r_ts) <= 21600000000 AS hit FROM m)
SELECT event_id, user_id, ts, CASE WHEN hit THEN r_ts END AS r_ts, CASE WHEN hit THEN r_event_id END AS r_event_id,
  CASE WHEN hit THEN r_value END AS r_value,
  CASE WHEN hit THEN (epoch_us(ts) - epoch_us(r_ts)) // 60000000 END AS lag_minutes FROM k
"""


def _asof(plan):
    def run(spark, d):
        left = _events(spark, d, "error").select("event_id", "user_id", "ts")
        right = _events(spark, d, "purchase").select("user_id", "ts", "event_id", "value")
        return j.asof_join(left, right, ["user_id"], "ts", HOURS_6, plan=plan)

    return run


query("asof_join", ASOF_SQL)(_asof("merge"))
query("asof_join_range", ASOF_SQL)(_asof("range"))


@query("asof_join_forward", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, ts AS r_ts, event_id AS r_event_id FROM events WHERE event_type = 'purchase')
SELECT event_id, l.user_id, ts, r_ts, r_event_id, (epoch_us(r_ts) - epoch_us(ts)) // 60000000 AS lag_minutes
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.r_ts
""")
def _(spark, d):
    left = _events(spark, d, "error").select("event_id", "user_id", "ts")
    right = _events(spark, d, "purchase").select("user_id", "ts", "event_id")
    return j.asof_join(left, right, ["user_id"], "ts", None, direction="forward")


@query("asof_join_ranked", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
c AS (SELECT user_id, user_id + k AS site, k + 1 AS "rank" FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1), (2)) v(k)),
r AS (SELECT user_id AS site, ts AS r_ts, event_id AS r_event_id FROM events WHERE event_type = 'purchase'),
m AS (SELECT event_id, user_id, ts, c.site, "rank", r_ts, r_event_id FROM l JOIN c USING (user_id)
  LEFT JOIN r ON r.site = c.site AND r_ts <= ts AND r_ts >= ts - INTERVAL 6 HOURS),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (r_ts IS NULL), "rank", r_ts DESC) AS rn FROM m)
SELECT event_id, user_id, ts, site, CAST("rank" AS INTEGER) AS "rank", r_ts, r_event_id,
  (epoch_us(ts) - epoch_us(r_ts)) // 60000000 AS lag_minutes FROM b WHERE rn = 1
""")
def _(spark, d):
    events = load(spark, d, "events")
    left = _events(spark, d, "error").select("event_id", "user_id", "ts")
    candidates = (
        events.select("user_id")
        .distinct()
        .select("user_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k"))
        .select("user_id", (F.col("user_id") + F.col("k")).alias("site"), (F.col("k") + 1).alias("rank"))
    )
    right = _events(spark, d, "purchase").select(F.col("user_id").alias("site"), "ts", "event_id")
    return j.asof_join_ranked(
        left, candidates, right, "event_id", "user_id", "site", "ts", HOURS_6
    )


@query("group_stat_join", """
SELECT l_orderkey, l_linenumber, l_partkey, n_lines, round(l_extendedprice - mean_price, 8) AS off_mean FROM lineitem
JOIN (SELECT l_partkey, count(*) AS n_lines, avg(l_extendedprice) AS mean_price FROM lineitem GROUP BY 1) USING (l_partkey)
""")
def _(spark, d):
    t = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    aggs = {"n_lines": F.count(F.lit(1)), "mean_price": F.avg("l_extendedprice")}
    return j.group_stat_join(t, ["l_partkey"], aggs).select(
        "l_orderkey", "l_linenumber", "l_partkey", "n_lines",
        F.round(F.col("l_extendedprice") - F.col("mean_price"), 8).alias("off_mean"),
    )


@query("restore_columns", """
SELECT o_orderkey, o_custkey, o_totalprice AS o_totalprice_removed, o_orderstatus AS o_orderstatus_removed FROM orders
""")
def _(spark, d):
    orders = load(spark, d, "orders")
    base = orders.select("o_orderkey", "o_custkey")
    early = orders.select("o_orderkey", "o_totalprice")
    later = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return j.restore_columns(base, [early, later], ["o_orderkey"])


@query("contains_join", """
SELECT doc_id, item_id FROM documents d, benchmark b
WHERE contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text))
""")
def _(spark, d):
    return j.contains_join(
        load(spark, d, "documents"), load(spark, d, "benchmark"), "doc_id", "text", "item_id", "text"
    )


@query("semi_by_key", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    return j.semi_by_key(docs, load(spark, d, "labels"), ["doc_id"])


@query("anti_by_key", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    return j.anti_by_key(docs, load(spark, d, "labels"), ["doc_id"])


@query("version_pairs", """
SELECT a.conv_id, a.exchange, length(a.text) AS len_1, length(b.text) AS len_2
FROM (SELECT conv_id, turn // 2 AS exchange, text FROM conversations WHERE role = 'user') a
JOIN (SELECT conv_id, turn // 2 AS exchange, text FROM conversations WHERE role = 'assistant') b USING (conv_id, exchange)
""")
def _(spark, d):
    t = load(spark, d, "conversations").select(
        "conv_id", F.expr("turn div 2").alias("exchange"), "role", F.length("text").cast("long").alias("len")
    )
    return j.version_pairs(t, "role", "user", "assistant", ["conv_id", "exchange"], ["len"])


@query("path_aggregate", """
SELECT l_suppkey, p_type, round(sum(l_quantity * p_retailprice), 2) AS exposure
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""")
def _(spark, d):
    holds = load(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("asset"), "l_quantity")
    exposed = load(spark, d, "part").select(F.col("p_partkey").alias("asset"), "p_type", "p_retailprice")
    out = j.path_aggregate(
        holds, exposed, "l_suppkey", "asset", "p_type", "l_quantity", "p_retailprice", "exposure"
    )
    return out.withColumn("exposure", F.round("exposure", 2))


@query("hierarchy_path", """
SELECT n_regionkey, c_nationkey, count(*) AS chains, count(DISTINCT l_suppkey) AS suppliers FROM (
 SELECT DISTINCT l_suppkey, l_orderkey, o_custkey, c_nationkey, n_regionkey FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2
""")
def _(spark, d):
    chains = j.hierarchy_path(
        [
            (load(spark, d, "lineitem"), "l_suppkey", "l_orderkey"),
            (load(spark, d, "orders"), "o_orderkey", "o_custkey"),
            (load(spark, d, "customer"), "c_custkey", "c_nationkey"),
            (load(spark, d, "nation"), "n_nationkey", "n_regionkey"),
        ]
    )
    return chains.groupBy("n_regionkey", "c_nationkey").agg(
        F.count(F.lit(1)).alias("chains"), F.countDistinct("l_suppkey").alias("suppliers")
    )


@query("incoming_activity", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey AS origin, o_custkey AS dest, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT DISTINCT dest, ts, count(*) OVER (PARTITION BY dest ORDER BY ts
  RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS n FROM t)
SELECT l_orderkey, l_linenumber, origin, t.dest, t.ts, coalesce(n, 0) AS incoming
FROM t LEFT JOIN a ON t.origin = a.dest AND t.ts = a.ts
""")
def _(spark, d):
    t = load(spark, d, "lineitem").join(
        load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    trips = t.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("origin"),
        F.col("o_custkey").alias("dest"), F.col("l_shipdate").alias("ts"),
    )
    return j.incoming_activity(trips, "origin", "dest", "ts", 7 * 86400, "incoming")
