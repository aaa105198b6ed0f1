"""Aggregated reports on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as r
from .registry import load, query


def rounded(df, *cols, places=4):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _late(spark, d):
    return load(spark, d, "orders").withColumn("late", (F.col("o_orderstatus") == "F").cast("int"))


RATE = """count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS positives, round(avg(o_totalprice), 7) AS mean,
 round(stddev_samp(o_totalprice), 4) AS std, round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 4) AS rate_pct,
 round(quantile_cont(o_totalprice, 0.95), 4) AS p95"""


@query("rate_by", f"""
SELECT o_orderpriority, year(o_orderdate)::INT AS year, {RATE} FROM orders GROUP BY 1, 2 HAVING count(*) >= 20
""")
def _(spark, d):
    t = _late(spark, d).withColumn("year", F.year("o_orderdate"))
    out = r.rate_by(t, ["o_orderpriority", "year"], "late", "o_totalprice", min_count=20)
    return rounded(rounded(out, "std", "rate_pct", "p95"), "mean", places=7)


@query("entity_scorecard", f"""
SELECT *, round(100 / (1 + std / abs(mean)), 3) AS consistency, round(100 - rate_pct, 4) AS on_time_pct
FROM (SELECT o_custkey, {RATE} FROM orders GROUP BY 1)
""")
def _(spark, d):
    out = r.entity_scorecard(_late(spark, d), "o_custkey", "late", "o_totalprice")
    out = rounded(rounded(out, "std", "rate_pct", "p95", "on_time_pct"), "consistency", places=3)
    return rounded(out, "mean", places=7)


@query("top_n", """
SELECT l_suppkey, n, round(revenue, 2) AS revenue FROM (
 SELECT l_suppkey, count(*) AS n, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1)
ORDER BY n DESC, l_suppkey LIMIT 20
""")
def _(spark, d):
    busy = load(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")
    )
    return r.top_n(busy, "n", 20, rerank="revenue", ties=["l_suppkey"])


@query("class_distribution", """
SELECT toxic, quality, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY toxic), 4) AS pct,
  round(avg(n_chars / 1000.0::DOUBLE), 4) AS mean_weight
FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2
""")
def _(spark, d):
    t = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    out = r.class_distribution(t.withColumn("w", F.col("n_chars") / 1000.0), "quality", "toxic", "w")
    return rounded(out, "pct", "mean_weight")


CARD_COLS = ["p_name", "p_brand", "p_type", "p_size", "p_partkey"]


@query("cardinality_report", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS nulls,
 round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS null_pct,
 round(count(DISTINCT {c})::DOUBLE / count(*), 6) AS distinct_share,
 CASE WHEN count(DISTINCT {c}) <= 2 THEN 'Binary' WHEN count(DISTINCT {c}) <= 10 THEN 'Low (2-10)'
  WHEN count(DISTINCT {c}) <= 50 THEN 'Medium (11-50)' WHEN count(DISTINCT {c}) <= 100 THEN 'High (51-100)'
  WHEN count(DISTINCT {c})::DOUBLE / count(*) > 0.5 THEN 'Extremely High (>50% unique)' ELSE 'Very High (>100)' END AS size_class
FROM (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS p_size, p_name FROM part)"""
    for c in CARD_COLS))
def _(spark, d):
    t = load(spark, d, "part").withColumn("p_size", F.when(F.col("p_size") <= 40, F.col("p_size")))
    out = r.cardinality_report(t, CARD_COLS)
    return rounded(rounded(out, "null_pct"), "distinct_share", places=6)


@query("cardinality_report_approx")
def _(spark, d):
    return r.cardinality_report(load(spark, d, "part"), CARD_COLS, exact=False)


@query("dq_summary", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, (count(*) - count({c}))::DOUBLE / count(*) AS null_rate,
 {f'min({c})::DOUBLE' if n else 'NULL::DOUBLE'} AS min, {f'max({c})::DOUBLE' if n else 'NULL::DOUBLE'} AS max,
 {f'round(quantile_cont({c}::DOUBLE, 0.5), 4)' if n else 'NULL::DOUBLE'} AS median FROM lineitem"""
    for c, t, n in (("l_orderkey", "bigint", 1), ("l_linenumber", "int", 1), ("l_quantity", "double", 1),
                    ("l_extendedprice", "double", 1), ("l_returnflag", "string", 0), ("l_shipdate", "timestamp_ntz", 0))))
def _(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    return rounded(r.dq_summary(load(spark, d, "lineitem").select(*cols)), "median")


@query("quantiles", "\nUNION ALL\n".join(
    f"SELECT l_returnflag, '{c}' AS metric, {p}::DOUBLE AS prob, round(quantile_cont({c}, {p}), 4) AS quantile FROM lineitem GROUP BY 1"
    for c in ("l_quantity", "l_extendedprice", "l_discount") for p in (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)))
def _(spark, d):
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    out = r.quantiles(
        load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], probs, ["l_returnflag"]
    )
    return rounded(out, "quantile")


@query("ordered_concat", """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS text,
  arg_min(role, turn) AS role FROM conversations GROUP BY 1
""")
def _(spark, d):
    return r.ordered_concat(
        load(spark, d, "conversations"), ["conv_id"], "text", ["turn", "role"], first="role"
    )


@query("distinct_sorted_concat", """
SELECT conv_id, string_agg(role, ' ' ORDER BY role) AS role FROM (SELECT DISTINCT conv_id, role FROM conversations)
GROUP BY 1
""")
def _(spark, d):
    return r.distinct_sorted_concat(load(spark, d, "conversations"), ["conv_id"], "role")


@query("flatten_lists", """
SELECT conv_id, array_to_string(flatten(list(string_split(text, '. ') ORDER BY turn)), ' | ') AS items
FROM conversations GROUP BY 1
""")
def _(spark, d):
    t = load(spark, d, "conversations").withColumn("items", F.split("text", r"\. ", -1))
    out = r.flatten_lists(t, ["conv_id"], "items", ["turn"])
    return out.select("conv_id", F.array_join("items", " | ").alias("items"))


METRICS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("long_summary", "\nUNION ALL\n".join(f"""
SELECT l_returnflag, l_linestatus, '{c}' AS metric, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 count({c}) AS n, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median,
 round(quantile_cont({c}, 0.75), 4) AS p75 FROM lineitem GROUP BY 1, 2""" for c in METRICS))
def _(spark, d):
    out = r.long_summary(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], METRICS)
    return rounded(out, "mean", "std", "p25", "median", "p75")


@query("pivot_metrics", """
SELECT l_linestatus, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS A,
  round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) AS N, round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS R
FROM lineitem GROUP BY 1
""")
def _(spark, d):
    out = r.pivot_metrics(load(spark, d, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"], "l_discount")
    return rounded(out, "A", "N", "R", places=6)


@query("melt", """
SELECT p_partkey, 'p_retailprice' AS variable, p_retailprice AS value FROM part WHERE p_retailprice <= 1500
UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE) FROM part
""")
def _(spark, d):
    t = load(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_retailprice") <= 1500, F.col("p_retailprice")).alias("p_retailprice"),
        F.col("p_size").cast("double").alias("p_size"),
    )
    return r.melt(t, ["p_partkey"], ["p_retailprice", "p_size"])


@query("melt_labelled", """WITH x AS (SELECT p_partkey, 'p_name' AS variable, 0 AS i, 'Part' AS label, trim(p_name) AS v FROM part
 UNION ALL SELECT p_partkey, 'p_type', 1, 'P Type', trim(p_type) FROM part WHERE p_size % 3 > 0
 UNION ALL SELECT p_partkey, 'p_size', 2, 'P Size', p_size::VARCHAR FROM part
 UNION ALL SELECT p_partkey, 'tags', 3, 'Tags', 'a, ' || p_size FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS rn FROM x WHERE v <> '')
SELECT p_partkey, variable, CASE WHEN length(v) > 12 THEN left(v, 11) || '…' ELSE v END AS value, label, CAST(rn AS INTEGER) AS position FROM n WHERE rn <= 3""")
def _(spark, d):
    t = load(spark, d, "part").withColumns({
        "p_type": F.when(F.col("p_size") % 3 > 0, F.col("p_type")),
        "tags": F.array(F.lit(" a"), F.lit(""), F.col("p_size").cast("string")),
    })
    return r.melt(t, ["p_partkey"], ["p_name", "p_type", "p_size", "tags"], labels={"p_name": "Part"}, max_chars=12, head=3)


@query("coverage_report", "\nUNION ALL\n".join(f"""
SELECT {t} AS threshold, count(*) FILTER (n >= {t}) AS instants, round(count(*) FILTER (n >= {t}) * 100.0::DOUBLE / count(*), 4) AS pct
FROM (SELECT date_trunc('hour', ts), count(DISTINCT user_id) AS n FROM events GROUP BY 1)""" for t in (1, 5, 10, 15)))
def _(spark, d):
    out = r.coverage_report(load(spark, d, "events"), F.date_trunc("hour", "ts"), "user_id", [1, 5, 10, 15])
    return rounded(out["thresholds"], "pct")


@query("coverage_yearly", """
SELECT year(h)::INT AS year, round(avg(n), 6) AS mean_entities
FROM (SELECT date_trunc('hour', ts) AS h, count(DISTINCT user_id) AS n FROM events GROUP BY 1) GROUP BY 1
""")
def _(spark, d):
    out = r.coverage_report(load(spark, d, "events"), F.date_trunc("hour", "ts"), "user_id", [1])
    return rounded(out["yearly"], "mean_entities", places=6)


def _delta_sql(c):
    parts = [f"'{c}' AS metric"]
    for m in "ANR":
        f = f"FILTER (l_returnflag = '{m}')"
        parts.append(f"round(avg({c}) {f}, 5) AS {m}_mean")
        parts += [f"round(quantile_cont({c}, {p}) {f}, 5) AS {m}_p{round(p * 100)}" for p in (0.1, 0.5, 0.9)]
    for a, b in (("A", "N"), ("A", "R"), ("N", "R")):
        fa, fb = f"FILTER (l_returnflag = '{a}')", f"FILTER (l_returnflag = '{b}')"
        parts.append(f"round(avg({c}) {fb} - avg({c}) {fa}, 5) AS mean_{b}_minus_{a}")
        parts.append(f"round(quantile_cont({c}, 0.5) {fb} - quantile_cont({c}, 0.5) {fa}, 5) AS median_{b}_minus_{a}")
    return f"SELECT {', '.join(parts)} FROM lineitem"


@query("delta_table", "\nUNION ALL\n".join(_delta_sql(c) for c in METRICS))
def _(spark, d):
    out = r.delta_table(load(spark, d, "lineitem"), "l_returnflag", ["A", "N", "R"], METRICS)
    return rounded(out, *[c for c in out.columns if c != "metric"], places=5)


@query("cohens_d", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS metric, round((avg({c}) FILTER (l_returnflag = 'R') - avg({c}) FILTER (l_returnflag = 'A')) / sqrt(
 ((count(*) FILTER (l_returnflag = 'A') - 1) * var_samp({c}) FILTER (l_returnflag = 'A')
 + (count(*) FILTER (l_returnflag = 'R') - 1) * var_samp({c}) FILTER (l_returnflag = 'R'))
 / (count(*) FILTER (l_returnflag IN ('A', 'R')) - 2)), 6) AS cohens_d FROM lineitem""" for c in METRICS))
def _(spark, d):
    return rounded(r.cohens_d(load(spark, d, "lineitem"), "l_returnflag", "A", "R", METRICS), "cohens_d", places=6)


_GAIN = "CASE WHEN stat = 'std' THEN a - b ELSE b - a END"


@query("compare_groups", f"""
WITH s AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median,
   stddev_samp(o_totalprice) AS std FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
l AS (SELECT g, 'mean' AS stat, mean AS v FROM s UNION ALL SELECT g, 'median', median FROM s UNION ALL SELECT g, 'std', std FROM s),
w AS (SELECT stat, max(v) FILTER (g = 'F') AS a, max(v) FILTER (g = 'O') AS b FROM l GROUP BY 1)
SELECT 'o_totalprice' AS metric, stat, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS diff,
  CASE WHEN {_GAIN} > 0 THEN 'O' WHEN {_GAIN} < 0 THEN 'F' ELSE 'Tie' END AS winner FROM w
""")
def _(spark, d):
    out = r.compare_groups(load(spark, d, "orders"), "o_orderstatus", "F", "O", ["o_totalprice"])
    return rounded(out, "a", "b", "diff")


def _arms(spark, d):
    per = load(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.round(F.max("o_totalprice") / 500000, 6).alias("score")
    )
    a, b = (per.filter(F.col("o_orderstatus") == s) for s in ("F", "O"))
    return r.win_table(a, b, "o_custkey", "score", ("filled", "open"))


WINS = """WITH p AS (SELECT o_custkey, o_orderstatus AS s, round(max(o_totalprice) / 500000, 6) AS score FROM orders GROUP BY 1, 2),
w AS (SELECT o_custkey, a.score AS filled, b.score AS "open", CASE WHEN a.score > b.score THEN 'filled'
  WHEN b.score > a.score THEN 'open' ELSE 'Tie' END AS winner, round(a.score - b.score, 6) AS diff, greatest(a.score, b.score) AS best
  FROM (SELECT * FROM p WHERE s = 'F') a JOIN (SELECT * FROM p WHERE s = 'O') b USING (o_custkey))"""


@query("win_table", f"{WINS} SELECT * FROM w")
def _(spark, d):
    return rounded(_arms(spark, d), "diff", places=6)


@query("win_counts", f"{WINS} SELECT winner, count(*) AS n, round(avg(abs(diff)), 6) AS mean_margin FROM w GROUP BY 1")
def _(spark, d):
    return rounded(r.win_counts(_arms(spark, d)), "mean_margin", places=6)


@query("win_extremes", f"""{WINS}
SELECT * FROM (SELECT *, 'top' AS list FROM w ORDER BY best DESC, o_custkey LIMIT 15)
UNION ALL SELECT * FROM (SELECT *, 'bottom' AS list FROM w WHERE best > 0.001 ORDER BY best, o_custkey LIMIT 15)
""")
def _(spark, d):
    return rounded(r.win_extremes(_arms(spark, d), "o_custkey", 15), "diff", places=6)


@query("large_differences", f"{WINS} SELECT * FROM w WHERE abs(diff) > 0.3")
def _(spark, d):
    return rounded(r.large_differences(rounded(_arms(spark, d), "diff", places=6), 0.3), "diff", places=6)


# Scores in [0, 1] derived from the events; purchases above 100 have no score.
SCORE = "CASE WHEN event_type = 'purchase' AND value > 100 THEN NULL WHEN value < 3 THEN 0 ELSE least(value / 150, 1) END"


@query("score_bands", f"""
SELECT event_type, count(*) FILTER (s >= 0.85) AS excellent, count(*) FILTER (s >= 0.7 AND s < 0.85) AS good,
 count(*) FILTER (s >= 0.5 AND s < 0.7) AS fair, count(*) FILTER (s >= 0.001 AND s < 0.5) AS poor,
 count(*) FILTER (s < 0.001) AS zero, count(*) FILTER (s IS NULL) AS nan
FROM (SELECT event_type, ({SCORE})::DOUBLE AS s FROM events) GROUP BY 1
""")
def _(spark, d):
    t = load(spark, d, "events").withColumn("s", F.expr(SCORE).cast("double"))
    return r.score_bands(t, "event_type", "s")


def _failures(spark, d):
    t = load(spark, d, "events").select(
        "event_id", "user_id", "event_type",
        F.expr(SCORE).cast("double").alias("s"),
        (F.col("value") / 300 - 0.002).alias("faith"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("context"),
    )
    return r.failure_causes(t, "s", {"faith": "Zero Faith", "context": "Zero/NaN Context"})


FAILED = f"""SELECT event_id, user_id, event_type, coalesce(nullif(concat_ws(', ', CASE WHEN value / 300 - 0.002 < 0.01 THEN 'Zero Faith' END,
 CASE WHEN event_type = 'view' OR value < 0.01 THEN 'Zero/NaN Context' END), ''), 'Unknown') AS causes
FROM events WHERE ({SCORE}) < 0.001"""


@query("failure_causes", FAILED)
def _(spark, d):
    return _failures(spark, d).select(
        "event_id", "user_id", "event_type", F.array_join("causes", ", ").alias("causes")
    )


@query("failing_in_both", f"""
WITH f AS ({FAILED}) SELECT user_id FROM f WHERE event_type = 'view'
INTERSECT SELECT user_id FROM f WHERE event_type = 'error'
""")
def _(spark, d):
    return r.failing_in_both(_failures(spark, d), "event_type", "view", "error", "user_id")


@query("mapping_check", """
WITH p AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
SELECT 'c_nationkey -> c_mktsegment' AS mapping, c_nationkey::VARCHAR AS key, count(*) AS partners FROM p GROUP BY c_nationkey HAVING count(*) > 1
UNION ALL SELECT 'c_mktsegment -> c_nationkey', c_mktsegment, count(*) FROM p GROUP BY c_mktsegment HAVING count(*) > 1
""")
def _(spark, d):
    return r.mapping_check(load(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("check_scores", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id, CASE WHEN event_type = 'view' AND value > 120 THEN NULL
  WHEN event_type = 'click' AND value > 120 THEN 'NaN'::DOUBLE WHEN event_type = 'error' AND value > 120 THEN 'inf'::DOUBLE ELSE value END AS v FROM events)
SELECT day, count(c_custkey) AS valid, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (isnan(v)) AS nans,
 count(*) FILTER (isinf(v)) AS infs, count(c_custkey) > 0 AND count(*) FILTER (v IS NULL OR isnan(v) OR isinf(v)) = 0 AS passed
FROM s LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') ON user_id = c_custkey GROUP BY 1
""")
def _(spark, d):
    v = F.expr(
        "CASE WHEN event_type = 'view' AND value > 120 THEN NULL WHEN event_type = 'click' AND value > 120"
        " THEN double('NaN') WHEN event_type = 'error' AND value > 120 THEN double('Infinity') ELSE value END"
    )
    t = load(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "user_id", v.alias("v"))
    universe = load(spark, d, "customer").filter("c_mktsegment = 'FURNITURE'").select(
        F.col("c_custkey").alias("user_id")
    )
    return r.check_scores(t, universe, "day", "user_id", "v")


@query("transition_table", """
SELECT prev, event_type, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY prev) AS BIGINT) AS total,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY prev), 4) AS pct
FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1, 2
""")
def _(spark, d):
    from ..operators.windows import previous_event

    t = previous_event(load(spark, d, "events"), ["user_id"], "ts", {"prev": "event_type"}, ["event_id"])
    return rounded(r.transition_table(t, "prev", "event_type"), "pct")


SWEEP = ["l_linenumber", "l_returnflag"]


@query("sweep_report", "\nUNION ALL\n".join(f"""
SELECT '{p}' AS param, {p}::VARCHAR AS setting, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std,
 count(*) FILTER (s < 0.001) AS zeros, round(quantile_cont(s, 0.5), 6) AS median
FROM (SELECT *, l_discount * l_quantity AS s FROM lineitem) GROUP BY {p}""" for p in SWEEP))
def _(spark, d):
    t = load(spark, d, "lineitem").withColumn("s", F.col("l_discount") * F.col("l_quantity"))
    return rounded(r.sweep_report(t, SWEEP, "s"), "mean", "std", "median", places=6)


@query("sweep_best", """
WITH p AS (SELECT l_linenumber || '/' || l_returnflag AS config, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std
 FROM lineitem GROUP BY l_linenumber, l_returnflag)
SELECT arg_max(config, mean) AS best_config, round(max(mean), 4) AS best_mean, arg_min(config, std) AS stable_config,
 round(min(std), 4) AS stable_std FROM p
""")
def _(spark, d):
    return rounded(r.sweep_best(load(spark, d, "lineitem"), SWEEP, "l_extendedprice"), "best_mean", "stable_std")


@query("sweep_pivot", """
SELECT l_linenumber, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A,
 round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY 1
""")
def _(spark, d):
    t = load(spark, d, "lineitem")
    out = r.pivot_metrics(t, "l_linenumber", "l_returnflag", ["A", "N", "R"], "l_quantity")
    return rounded(out, "A", "N", "R", places=6)
