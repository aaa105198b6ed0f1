"""Splits, class balance, encoders and feature selection on the driver tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import encode as en
from ..operators import sampling as s
from ..operators import select as sel
from .registry import load, query
from .reporting import rounded


def HASH(key):
    return f"CAST('0x' || substr(md5('42|' || {key}), 1, 15) AS BIGINT)"


SPACE = "1152921504606846976"
LABELLED = "(SELECT l.*, lang, source, n_chars FROM labels l JOIN documents USING (doc_id))"


def _labelled(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return load(spark, d, "labels").join(docs, "doc_id")


@query("time_split", """
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val'
  ELSE 'test' END AS split FROM orders
""")
def _(spark, d):
    out = s.time_split(load(spark, d, "orders"), "o_orderdate", "1998-01-01", "2000-01-01")
    return out.select("o_orderkey", "split")


@query("hash_split", f"""
SELECT doc_id, CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.8 THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, {HASH('doc_id')} / {SPACE}.0::DOUBLE AS h FROM documents)
""")
def _(spark, d):
    parts = {"train": 0.6, "val": 0.2, "test": 0.2}
    return s.hash_split(load(spark, d, "documents"), ["doc_id"], parts).select("doc_id", "split")


@query("hash_split_stratified", f"""
SELECT doc_id, lang, CASE WHEN p < 0.3 THEN 'explore' ELSE 'confirm' END AS split FROM (SELECT doc_id, lang,
  (row_number() OVER (PARTITION BY lang ORDER BY {HASH('doc_id')}, doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY lang) AS p FROM documents)
""")
def _(spark, d):
    out = s.hash_split(
        load(spark, d, "documents"), ["doc_id"], {"explore": 0.3, "confirm": 0.7}, strata=["lang"]
    )
    return out.select("doc_id", "lang", "split")


@query("stratified_folds", f"""
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {HASH('doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels
""")
def _(spark, d):
    return s.stratified_folds(load(spark, d, "labels"), "quality", ["doc_id"], 5).select(
        "doc_id", "quality", "fold"
    )


@query("undersample", f"""
WITH n AS (SELECT count(*) FILTER (toxic = 1)::DOUBLE AS a, count(*) FILTER (toxic = 0)::DOUBLE AS b FROM labels)
SELECT doc_id, toxic FROM labels, n WHERE CASE WHEN (toxic = 1) = (a > b)
 THEN {HASH('doc_id')} < CAST(floor(least(1, least(a, b) / greatest(a, b) / 0.5) * {SPACE}.0::DOUBLE) AS BIGINT) ELSE true END
""")
def _(spark, d):
    return s.undersample(load(spark, d, "labels"), "toxic", ["doc_id"], 0.5).select("doc_id", "toxic")


@query("stratified_take", f"""
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {HASH('doc_id')}, doc_id) AS rn FROM labels)
WHERE rn <= CASE quality WHEN 1 THEN 60 ELSE 40 END
""")
def _(spark, d):
    out = s.stratified_take(load(spark, d, "labels"), "quality", ["doc_id"], {1: 60, 0: 40})
    return out.select("doc_id", "quality")


@query("class_weights", """
SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)) * CASE quality WHEN 1 THEN 2 ELSE 1 END, 6) AS class_weight
FROM labels GROUP BY quality
""")
def _(spark, d):
    out = s.class_weights(load(spark, d, "labels"), "quality", multipliers={1: 2.0})
    return rounded(out, "class_weight", places=6)


FACTORS = """f AS (SELECT lang, count(*) AS n, CASE WHEN lang = 'en' THEN 1 ELSE
  CAST(least(round_even(max(count(*)) OVER () / count(*)::DOUBLE, 0), 50) AS INTEGER) END AS factor FROM documents GROUP BY lang)"""


@query("oversample_factors", f"WITH {FACTORS} SELECT * FROM f")
def _(spark, d):
    return s.oversample_factors(load(spark, d, "documents"), "lang", 50, "en")


@query("oversample", f"""
WITH {FACTORS} SELECT doc_id, d.lang, CAST(c AS INTEGER) AS copy FROM documents d JOIN f ON d.lang = f.lang, unnest(range(1, factor + 1)) t(c)
""")
def _(spark, d):
    return s.oversample(load(spark, d, "documents").select("doc_id", "lang"), "lang", 50, "en")


@query("magnitude_weights", """
SELECT l_returnflag, CASE WHEN p <= 60 THEN 1.0 WHEN p <= 120 THEN 2.0 ELSE 2.5 END::DOUBLE AS weight, count(*) AS n
FROM (SELECT l_returnflag, l_extendedprice / 600 AS p FROM lineitem) GROUP BY ALL
""")
def _(spark, d):
    w = s.magnitude_weight(F.col("l_extendedprice") / 600)
    return load(spark, d, "lineitem").groupBy("l_returnflag", w.cast("double").alias("weight")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("target_encode", """
WITH t AS (SELECT o_orderkey, o_orderpriority AS p, c_nationkey AS c, o_orderdate, (o_orderstatus = 'F')::DOUBLE AS y
  FROM orders JOIN customer ON o_custkey = c_custkey),
tr AS (SELECT * FROM t WHERE o_orderdate < TIMESTAMP '1999-01-01' AND p <> '5-LOW'), g AS (SELECT avg(y) AS gm FROM tr),
a AS (SELECT p, (sum(y) + 100 * any_value(gm)) / (count(*) + 100) AS e FROM tr, g GROUP BY p),
b AS (SELECT c, (sum(y) + 100 * any_value(gm)) / (count(*) + 100) AS e FROM tr, g GROUP BY c)
SELECT o_orderkey, round(coalesce(a.e, gm), 6) AS p_encoded, round(coalesce(b.e, gm), 6) AS c_encoded
FROM t LEFT JOIN a USING (p) LEFT JOIN b USING (c), g
""")
def _(spark, d):
    t = load(spark, d, "orders").join(
        load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        "o_orderkey", F.col("o_orderpriority").alias("p"), F.col("c_nationkey").alias("c"), "o_orderdate",
        (F.col("o_orderstatus") == "F").cast("double").alias("y"),
    )
    train = t.filter("o_orderdate < timestamp_ntz'1999-01-01' and p <> '5-LOW'")
    out = en.target_encode(train, t, ["p", "c"], "y").select("o_orderkey", "p_encoded", "c_encoded")
    return rounded(out, "p_encoded", "c_encoded", places=6)


def _one_hot_sql(column):
    """Indicators of the levels by falling frequency over their deviation, and a zero for unseen levels."""
    return f"""(SELECT list(CASE WHEN v = o.{column} THEN round(1 / sd, 6) ELSE 0 END ORDER BY n DESC, v) FROM (SELECT {column} AS v, count(*) AS n,
 sqrt(count(*)::DOUBLE * (t - count(*)) / t / (t - 1)) AS sd FROM orders, (SELECT count(*) AS t FROM orders) GROUP BY {column}, t))"""


@query("encode_pipeline", f"""SELECT o_orderkey, list_concat({_one_hot_sql('o_orderpriority')}, [0.0::DOUBLE], {_one_hot_sql('o_orderstatus')}, [0.0::DOUBLE],
 [round(o_totalprice / (SELECT stddev_samp(o_totalprice) FROM orders), 6)]) AS features FROM orders o""")
def _(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    model = en.encode_pipeline(["o_orderpriority", "o_orderstatus"], ["o_totalprice"], scale=True).fit(t)
    features = F.transform(vector_to_array("features"), lambda x: F.round(x, 6))
    return model.transform(t).select("o_orderkey", features.alias("features"))


@query("route_encoders", """
SELECT "column", n AS distinct_values, CASE WHEN "column" = 'p_brand' THEN 'target' WHEN "column" = 'p_size' THEN 'one_hot'
  WHEN n = 2 THEN 'binary' WHEN n > 30 THEN 'target' WHEN n >= 3 THEN 'one_hot' ELSE 'none' END AS route, "column" IN ('p_brand', 'p_size') AS required
FROM (SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
 UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
 UNION ALL SELECT 'large', count(DISTINCT p_size > 25) FROM part)
""")
def _(spark, d):
    t = load(spark, d, "part").withColumn("large", F.col("p_size") > 25)
    return en.route_encoders(
        t, ["p_brand", "p_type", "p_name", "p_size", "large"], one_hot=["p_size"], target=["p_brand"]
    )


@query("route_scalers", """
SELECT * FROM (SELECT 'l_quantity' AS "column", 'robust' AS scaler, round(avg(l_quantity), 6) AS mean FROM lineitem
UNION ALL SELECT 'l_discount', 'minmax', round(avg(l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', 'standard', round(avg(l_tax), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'standard', round(avg(l_extendedprice), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice_log', 'standard', round(avg(ln(1 + l_extendedprice)), 6) FROM lineitem)
""")
def _(spark, d):
    t = load(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.log1p("l_extendedprice").alias("l_extendedprice_log")
    )
    groups = en.route_scalers(t, "label", ["l_quantity", "l_extendedprice"], ["l_discount"])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(g).alias("scaler"), F.round(F.col(c), 6).alias("mean"))
            for g, cs in groups.items()
            for c in cs
        ]
    )
    return t.agg(*[F.avg(c).alias(c) for c in t.columns]).select(F.inline(rows))


@query("scaler_pipeline", """WITH s AS (SELECT quantile_disc(l_quantity, 0.75) - quantile_disc(l_quantity, 0.25) AS iqr, min(l_discount) AS lo, max(l_discount) AS hi,
 avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp, avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem)
SELECT l_orderkey, [round(l_quantity / iqr, 5)] AS scaled_robust, [round((l_discount - lo) / (hi - lo), 5)] AS scaled_minmax,
 [round((l_extendedprice - mp) / sp, 5), round((l_tax - mt) / st, 5)] AS scaled_standard FROM lineitem, s""")
def _(spark, d):
    t = load(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    groups = en.route_scalers(t, "l_orderkey", ["l_quantity"], ["l_discount"])
    out = en.scaler_pipeline(groups).fit(t).transform(t)
    cols = [c for c in out.columns if c.startswith("scaled_")]
    return out.select("l_orderkey", *[F.transform(vector_to_array(c), lambda x: F.round(x, 5)).alias(c) for c in cols])


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
LATE = "(l_returnflag = 'R')::INT"


def _lines(spark, d):
    t = load(spark, d, "lineitem").withColumn("late", (F.col("l_returnflag") == "R").cast("int"))
    return t.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query("target_corr", f"""
WITH c AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, {LATE}) AS corr FROM lineitem" for c in NUM)})
SELECT feature, round(corr, 6) AS corr, round(abs(corr) / sum(abs(corr)) OVER (), 6) AS weight FROM c
""")
def _(spark, d):
    return rounded(sel.target_corr(_lines(spark, d), NUM, "late"), "corr", "weight", places=6)


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_net"), ("l_extendedprice", "l_net"), ("l_discount", "l_net"),
         ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query("redundant_pairs", "WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS l_net, " + LATE + " AS late FROM lineitem) " + " UNION ALL ".join(f"""
SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr,
 CASE WHEN abs(corr({a}, late)) >= abs(corr({b}, late)) THEN '{a}' ELSE '{b}' END AS keep,
 CASE WHEN abs(corr({a}, late)) >= abs(corr({b}, late)) THEN '{b}' ELSE '{a}' END AS drop FROM t HAVING abs(corr({a}, {b})) > 0.8""" for a, b in PAIRS))
def _(spark, d):
    out = sel.redundant_pairs(_lines(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_net"], "late", 0.8)
    return rounded(out, "corr", places=6)


def _avg_rank(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


@query("rank_corr_compare", f"""
WITH r AS (SELECT o_totalprice AS y, exp(o_totalprice / 40000) AS e, o_custkey AS u, {_avg_rank('o_totalprice')} AS ry,
  {_avg_rank('exp(o_totalprice / 40000)')} AS re, {_avg_rank('o_custkey')} AS ru FROM orders),
m AS (SELECT 'e' AS feature, corr(e, y) AS p, corr(re, ry) AS s FROM r UNION ALL SELECT 'u', corr(u, y), corr(ru, ry) FROM r)
SELECT feature, round(p, 6) AS pearson, round(s, 6) AS spearman, round(abs(s - p), 6) AS difference,
 CASE WHEN abs(s) > abs(p) THEN 'Spearman' ELSE 'Pearson' END AS stronger, abs(s) > abs(p) AND abs(s - p) > 0.05 AS non_linear FROM m
""")
def _(spark, d):
    t = load(spark, d, "orders").select(
        F.col("o_totalprice").alias("y"), F.exp(F.col("o_totalprice") / 40000).alias("e"), F.col("o_custkey").alias("u")
    )
    return rounded(sel.rank_corr_compare(t, ["e", "u"], "y"), "pearson", "spearman", "difference", places=6)


def _anova(c):
    return f"""SELECT '{c}' AS feature, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n,
 (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f
 FROM (SELECT {c}, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1),
 (SELECT avg(l_extendedprice) AS gm FROM lineitem)"""


@query("anova_f", " UNION ALL ".join(
    f"SELECT feature, groups, n, round(f, 5) AS f FROM ({_anova(c)}) WHERE groups >= 2"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey")))
def _(spark, d):
    out = sel.anova_f(
        load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], "l_extendedprice"
    )
    return rounded(out.select("feature", "groups", "n", "f"), "f", places=5)


@query("duplicate_columns", """
SELECT 'qty_copy' AS "column", 'l_quantity' AS same_as FROM lineitem HAVING count(*) FILTER (l_quantity IS DISTINCT FROM l_quantity + 0) = 0
""")
def _(spark, d):
    t = load(spark, d, "lineitem").withColumns({"qty_copy": F.col("l_quantity") + 0, "qty_next": F.col("l_quantity") + 1})
    return sel.duplicate_columns(t, ["l_quantity", "l_tax", "qty_copy", "qty_next", "l_discount"])


@query("threshold_flags", """
WITH t AS (SELECT event_id, value AS v, user_id AS u, (event_type = 'error')::INT AS y FROM events),
q AS (SELECT quantile_cont(v, 0.75) AS a, quantile_cont(u, 0.25) AS b FROM t WHERE y = 1),
f AS (SELECT event_id, y, (v >= a)::INT AS big_value, (u <= b)::INT AS low_user FROM t, q),
c AS (SELECT abs(corr(y, big_value)) AS ca, abs(corr(y, low_user)) AS cb FROM f)
SELECT event_id, big_value, low_user, round(big_value * (ca / (ca + cb)) + low_user * (cb / (ca + cb)), 6) AS extreme_score FROM f, c
""")
def _(spark, d):
    t = load(spark, d, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    rules = {"big_value": ("value", 0.75, ">="), "low_user": ("user_id", 0.25, "<=")}
    out = sel.threshold_flags(t, "y", rules).select("event_id", "big_value", "low_user", "extreme_score")
    return rounded(out, "extreme_score", places=6)


@query("selection_report", f"""
WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS l_net, {LATE} AS late FROM lineitem),
n AS (SELECT corr(l_extendedprice, late) AS p, corr(l_net, late) AS q, corr(l_tax, late) AS x, corr(l_extendedprice, l_net) AS pq FROM t),
a AS (SELECT 'l_linestatus' AS feature, {_anova('l_linestatus').split('AS n,', 1)[1].replace('l_extendedprice', 'late').replace('FROM lineitem', 'FROM t').replace(' AS f', ' AS f', 1)}),
r AS (SELECT 'l_extendedprice' AS feature, round(p, 6) AS corr, CASE WHEN abs(pq) > 0.95 AND abs(p) < abs(q) THEN 'redundant' END AS reasons FROM n
 UNION ALL SELECT 'l_net', round(q, 6), CASE WHEN abs(pq) > 0.95 AND abs(p) >= abs(q) THEN 'redundant' END FROM n
 UNION ALL SELECT 'l_tax', round(x, 6), NULL FROM n
 UNION ALL SELECT feature, NULL, CASE WHEN f < 3.8415 THEN 'insignificant' END FROM a)
SELECT *, CASE WHEN reasons IS NULL THEN 'KEEP' ELSE 'DROP' END AS advice FROM r
""")
def _(spark, d):
    out = sel.selection_report(_lines(spark, d), ["l_extendedprice", "l_net", "l_tax"], ["l_linestatus"], "late")
    return rounded(out, "corr", places=6)


@query("quality_filter", f"""
WITH t AS (SELECT doc_id, least(n_chars / 6000.0::DOUBLE, 1) AS score, (doc_id * 37 % 101) / 101.0::DOUBLE AS sim, (doc_id * 53 % 97) / 97.0::DOUBLE AS dens FROM {LABELLED}),
h AS (SELECT * FROM t WHERE score >= 0.5 AND score < 0.7), q AS (SELECT quantile_cont(sim, 0.25) AS a, quantile_cont(dens, 0.25) AS b FROM h),
p AS (SELECT h.* FROM h, q WHERE sim >= a AND dens >= b),
m AS (SELECT min(score) AS s0, max(score) AS s1, min(sim) AS m0, max(sim) AS m1, min(dens) AS d0, max(dens) AS d1 FROM p),
r AS (SELECT doc_id, (score - s0) / (s1 - s0 + 1e-6) * 0.5 + (sim - m0) / (m1 - m0 + 1e-6) * 0.3 + (dens - d0) / (d1 - d0 + 1e-6) * 0.2 AS hs FROM p, m)
SELECT doc_id, 'high' AS tier, NULL::DOUBLE AS hard_score FROM t WHERE score >= 0.7
UNION ALL (SELECT doc_id, 'hard', round(hs, 6) FROM r ORDER BY hs DESC, doc_id LIMIT 20)
""")
def _(spark, d):
    t = _labelled(spark, d).select(
        "doc_id",
        F.least(F.col("n_chars") / 6000.0, F.lit(1.0)).alias("score"),
        (F.col("doc_id") * 37 % 101 / 101.0).alias("sim"),
        (F.col("doc_id") * 53 % 97 / 97.0).alias("dens"),
    )
    out = s.quality_filter(t, "score", ["sim", "dens"], ["score", "sim", "dens"], 20, ["doc_id"])
    return rounded(out.select("doc_id", "tier", "hard_score"), "hard_score", places=6)


@query("log_candidates", """
WITH t AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS chars, doc_id * 1.0::DOUBLE AS flat FROM documents), m AS (SELECT avg(chars) AS a, stddev_pop(chars) AS sd FROM t),
k AS (SELECT avg(pow((chars - a) / sd, 3)) AS skew FROM t, m)
SELECT doc_id, CASE WHEN skew > 2 THEN round(ln(1 + chars), 6) END AS chars_log FROM t, k
""")
def _(spark, d):
    t = load(spark, d, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("chars"), F.col("doc_id").cast("double").alias("flat")
    )
    return rounded(sel.add_log_twins(t, ["chars", "flat"]).select("doc_id", "chars_log"), "chars_log", places=6)
