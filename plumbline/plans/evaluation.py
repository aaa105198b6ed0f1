"""Models, metrics and error slices on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as b
from ..operators import evaluate as e
from ..operators import models as m
from ..operators import report as r
from .registry import load, query
from .reporting import rounded
from .sampling import _labelled
from .windowing import BARS, DAYNO, _bars

# Two predictions of the quantity in log units, from price and discount.
PRED = """p AS (SELECT *, ln(1 + l_quantity) AS y, ln(1 + l_extendedprice / 2000) AS a, ln(1 + l_quantity * (0.7 + l_discount * 6)) AS b FROM lineitem)"""


def _pairs(spark, d):
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").withColumns(
        {
            "y": F.ln(1 + q),
            "a": F.ln(1 + F.col("l_extendedprice") / 2000),
            "b": F.ln(1 + q * (0.7 + F.col("l_discount") * 6)),
        }
    )


# Binary labels with a score from the text length.
SCORED = """s AS (SELECT l.doc_id, quality AS label, lang, least(n_chars / 8000.0::DOUBLE, 1) AS score, (n_chars >= 2500)::INT AS pred
 FROM labels l JOIN documents USING (doc_id))"""


def _scored(spark, d):
    return _labelled(spark, d).select(
        "doc_id", F.col("quality").alias("label"), "lang", "n_chars",
        F.least(F.col("n_chars") / 8000.0, F.lit(1.0)).alias("score"),
        (F.col("n_chars") >= 2500).cast("int").alias("pred"),
    )


def _fold_sql(rolling):
    first = "lag(hi, 1, NULL) OVER (ORDER BY fold)" if rolling else "NULL"
    return f"""WITH o AS (SELECT {DAYNO} AS day FROM orders), c AS (SELECT i, CAST(floor(quantile_cont(day, i / 4.0)) AS BIGINT) AS cut
  FROM o, (VALUES (1), (2), (3), (4)) v(i) GROUP BY i),
f AS (SELECT a.i AS fold, a.cut AS hi, z.cut AS top FROM c a JOIN c z ON z.i = a.i + 1),
s AS (SELECT fold, 'train' AS role, coalesce({first} + 1, -1000000) AS lo, hi FROM f UNION ALL SELECT fold, 'val', hi + 1, top FROM f)
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM s JOIN o ON day BETWEEN lo AND hi GROUP BY 1, 2"""


# DuckDB wants a constant probability, so the four cuts are spelled out.
_CUTS = "c AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, CAST(floor(quantile_cont(day, {i / 4})) AS BIGINT) AS cut FROM o" for i in (1, 2, 3, 4)) + ")"


def _folds_sql(rolling):
    s = _fold_sql(rolling)
    start, rest = s.split(", c AS (", 1)
    return start + ", " + _CUTS + "," + rest.split("GROUP BY i),", 1)[1]


@query("expanding_folds", _folds_sql(False))
def _(spark, d):
    t = load(spark, d, "orders")
    return m.fold_table(t, "o_orderdate", m.expanding_folds(t, "o_orderdate", 3))


@query("rolling_folds", _folds_sql(True))
def _(spark, d):
    t = load(spark, d, "orders")
    return m.fold_table(t, "o_orderdate", m.rolling_folds(t, "o_orderdate", 3))


@query("fold_weights", f"""
WITH x AS ({_folds_sql(False)}) SELECT round(sum(n * pow(0.5, 3 - fold)) / sum(pow(0.5, 3 - fold)), 6) AS score FROM x WHERE role = 'val'
""")
def _(spark, d):
    t = load(spark, d, "orders")
    folds = m.fold_table(t, "o_orderdate", m.expanding_folds(t, "o_orderdate", 3)).filter("role = 'val'")
    return rounded(m.weighted_score(folds, "fold", "n", m.fold_weights(3, "exponential")), "score", places=6)


def _model_rows(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_shipdate",
        (F.col("l_extendedprice") > 30000).cast("int").alias("large"),
        F.ln(1 + F.col("l_extendedprice")).alias("size"),
    )


CAT, NUMS = ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount", "l_tax"]


@query("grid_search")
def _(spark, d):
    t = _model_rows(spark, d)
    folds = m.expanding_folds(t, "l_shipdate", 2)
    results = m.grid_search(
        t, "l_shipdate", folds, {"regParam": [0.0, 0.5]},
        lambda p: m.model_pipeline("regression", "linear", CAT, NUMS, "size", **p),
        lambda scored: m.rmse(scored, "size"),
    )
    return results


# Models whose solution has a closed form, checked in full.
LINE = "t AS (SELECT l_quantity AS x, ln(1 + l_extendedprice) AS y, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day FROM lineitem)"


@query("grid_search_line", f"""WITH {LINE}, c AS (SELECT floor(quantile_cont(day, 1.0::DOUBLE / 3)) AS c1, floor(quantile_cont(day, 2.0::DOUBLE / 3)) AS c2, max(day) AS c3 FROM t),
f AS (SELECT 1 AS fold, x, y, day <= c1 AS train, day > c1 AND day <= c2 AS val FROM t, c UNION ALL SELECT 2, x, y, day <= c2, day > c2 AND day <= c3 FROM t, c),
w AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum(x * y) / sum(x * x) AS b0 FROM f WHERE train GROUP BY 1)
SELECT '[(''fitIntercept'', True)]' AS params, fold, round(sqrt(avg(pow(a + b * x - y, 2))), 5) AS score FROM f JOIN w USING (fold) WHERE val GROUP BY fold
UNION ALL SELECT '[(''fitIntercept'', False)]', fold, round(sqrt(avg(pow(b0 * x - y, 2))), 5) FROM f JOIN w USING (fold) WHERE val GROUP BY fold""")
def _(spark, d):
    t = _model_rows(spark, d)
    results = m.grid_search(
        t, "l_shipdate", m.expanding_folds(t, "l_shipdate", 2), {"fitIntercept": [True, False]},
        lambda p: m.model_pipeline("regression", "linear", [], ["l_quantity"], "size", **p),
        lambda scored: m.rmse(scored, "size"),
    )
    return rounded(results, "score", places=5)


@query("fit_regressor_line", f"WITH {LINE}, w AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t) SELECT x AS l_quantity, round(any_value(a + b * x), 5) AS prediction, count(*) AS n FROM t, w GROUP BY 1")
def _(spark, d):
    t = _model_rows(spark, d)
    scored = m.fit_regressor(t, "linear", [], ["l_quantity"], "size").transform(t)
    return rounded(scored.groupBy("l_quantity").agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n")), "prediction", places=5)


def _stepped(spark, d):
    return load(spark, d, "lineitem").select("l_linenumber", "l_tax", "l_quantity", (F.col("l_linenumber") >= 4).cast("int").alias("high"))


@query("fit_classifier_step", "SELECT (l_linenumber >= 4)::INT AS high, (l_linenumber >= 4)::DOUBLE AS prediction, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    t = _stepped(spark, d)
    scored = m.fit_classifier(t, "tree", [], ["l_linenumber", "l_tax"], "high").transform(t)
    return scored.groupBy("high", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("two_stage_step", """WITH w AS (SELECT regr_slope(l_quantity, l_linenumber) AS b, regr_intercept(l_quantity, l_linenumber) AS a FROM lineitem WHERE l_linenumber >= 4)
SELECT l_linenumber, (l_linenumber >= 4)::DOUBLE AS pred_flag, round(any_value(CASE WHEN l_linenumber >= 4 THEN a + b * l_linenumber ELSE 0 END), 5) AS prediction, count(*) AS n FROM lineitem, w GROUP BY 1, 2""")
def _(spark, d):
    t = _stepped(spark, d)
    out = m.two_stage(t, t, [], ["l_linenumber"], "high", "l_quantity", classifier="tree", regressor="linear")
    per = out.groupBy("l_linenumber", "pred_flag").agg(F.avg("prediction").alias("prediction"), F.count(F.lit(1)).alias("n"))
    return rounded(per, "prediction", places=5)


@query("feature_importance_step", "SELECT * FROM (VALUES ('l_linenumber', 1.0::DOUBLE), ('l_tax', 0.0::DOUBLE)) v(feature, importance)")
def _(spark, d):
    t = _stepped(spark, d)
    model = m.fit_regressor(t, "tree", [], ["l_linenumber", "l_tax"], "high", maxDepth=1)
    return m.feature_importance(model, model.transform(t))


@query("score_features_checked", "SELECT count(*) AS n, 0::BIGINT AS no_probability, 0::BIGINT AS wrong_bin FROM lineitem")
def _(spark, d):
    out = m.score_features(_model_rows(spark, d), NUMS, "large", ["l_orderkey", "l_shipdate"])
    expected = F.expr("CASE WHEN forest_prob < 0.1 THEN 1 WHEN forest_prob < 0.2 THEN 2 WHEN forest_prob < 0.3 THEN 3 WHEN forest_prob < 0.5 THEN 4 ELSE 5 END")
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("forest_prob").between(0, 1), F.lit(False))).alias("no_probability"),
        F.count_if(F.col("forest_bin") != expected).alias("wrong_bin"),
    )


@query("fit_regressor")
def _(spark, d):
    t = _model_rows(spark, d)
    model = m.fit_regressor(t, "gbt", CAT, NUMS, "size", maxIter=3, maxDepth=3, seed=7)
    return e.regression_metrics(model.transform(t), "prediction", "size")


@query("fit_classifier")
def _(spark, d):
    t = _model_rows(spark, d)
    model = m.fit_classifier(t, "logistic", CAT, NUMS, "large", maxIter=10)
    return e.auc(m.with_probability(model.transform(t)), "prob", "large")


@query("two_stage")
def _(spark, d):
    t = _model_rows(spark, d)
    out = m.two_stage(t, t, CAT, NUMS, "large", "size", maxDepth=3)
    return out.groupBy("pred_flag").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"))


@query("feature_importance")
def _(spark, d):
    t = _model_rows(spark, d)
    model = m.fit_regressor(t, "tree", CAT, NUMS, "size", maxDepth=4)
    return m.feature_importance(model, model.transform(t))


@query("score_features")
def _(spark, d):
    out = m.score_features(_model_rows(spark, d), NUMS, "large", ["l_orderkey", "l_shipdate"])
    return out.groupBy("forest_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("forest_prob").alias("mean_prob"))


@query("gate_predictions", """
SELECT l_returnflag, round(sum(CASE WHEN l_discount * 8 > 0.25 THEN l_quantity ELSE 0 END), 4) AS pred_gated,
 round(sum(l_quantity), 4) AS pred_regression, round(sum(l_discount * 8 * l_quantity), 4) AS pred_expected FROM lineitem GROUP BY 1
""")
def _(spark, d):
    t = load(spark, d, "lineitem").withColumn("prob", F.col("l_discount") * 8)
    out = e.gate_predictions(t, "prob", "l_quantity")
    cols = ["pred_gated", "pred_regression", "pred_expected"]
    return out.groupBy("l_returnflag").agg(*[F.round(F.sum(c), 4).alias(c) for c in cols])


@query("blend", f"""
WITH {PRED} SELECT l_orderkey, l_linenumber, l_partkey, round((a + b) / 2, 6) AS pred_avg, round(a * 0.3 + b * 0.7, 6) AS pred_weighted,
 round(greatest(a, b), 6) AS pred_max, round(least(a, b), 6) AS pred_min FROM p
""")
def _(spark, d):
    cols = ["pred_avg", "pred_weighted", "pred_max", "pred_min"]
    out = e.blend(_pairs(spark, d), ["a", "b"], [0.3, 0.7]).select("l_orderkey", "l_linenumber", "l_partkey", *cols)
    return rounded(out, *cols, places=6)


@query("adaptive_blend", f"""
WITH {PRED} SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN exp((a + b) / 2) - 1 > 30 THEN greatest(a, b) ELSE least(a, b) END, 6) AS pred_adaptive FROM p
""")
def _(spark, d):
    out = e.AdaptiveBlend(inputCols=["a", "b"]).transform(_pairs(spark, d))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "pred_adaptive"), "pred_adaptive", places=6)


def _reg(p):
    err = f"((exp({p}) - 1) - (exp(y) - 1))"
    return f"""count(*) AS n, round(sqrt(avg({err} * {err})), 5) AS rmse, round(avg(abs({err})), 5) AS mae,
 round(quantile_cont(abs({err}), 0.5), 5) AS p50, round(quantile_cont(abs({err}), 0.9), 5) AS p90, round(quantile_cont(abs({err}), 0.99), 5) AS p99"""


@query("regression_metrics", f"WITH {PRED} SELECT {_reg('a')} FROM p")
def _(spark, d):
    return rounded(e.regression_metrics(_pairs(spark, d), "a", "y"), "rmse", "mae", "p50", "p90", "p99", places=5)


@query("strategy_table", f"WITH {PRED} " + " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, {_reg(x)} FROM p" for n, x in
    (("a", "a"), ("b", "b"), ("pred_avg", "((a + b) / 2)"), ("pred_max", "greatest(a, b)"), ("pred_min", "least(a, b)"))))
def _(spark, d):
    t = e.blend(_pairs(spark, d), ["a", "b"])
    out = e.strategy_table(t, ["a", "b", "pred_avg", "pred_max", "pred_min"], "y")
    return rounded(out, "rmse", "mae", "p50", "p90", "p99", places=5)


@query("to_binary", f"""
WITH {PRED}, z AS (SELECT *, exp(a) - 1 AS s FROM p) SELECT l_orderkey, l_linenumber, l_partkey, round(s, 7) AS pred_size, (s >= 15)::INT AS pred_class,
 round(CASE WHEN s < 0 THEN 0 WHEN s > 40 THEN 1 ELSE s / 40 END, 9) AS pred_probability FROM z
""")
def _(spark, d):
    out = e.to_binary(_pairs(spark, d), "a", 15, 40)
    out = out.select("l_orderkey", "l_linenumber", "l_partkey", "pred_size", "pred_class", "pred_probability")
    return rounded(rounded(out, "pred_size", places=7), "pred_probability", places=9)


RATES = ["accuracy", "precision", "recall", "specificity", "npv", "f1", "f2", "f05"]


@query("binary_metrics", f"""
WITH {SCORED}, c AS (SELECT count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp,
 count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 0 AND label = 0) AS tn FROM s),
r AS (SELECT *, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall,
 tn::DOUBLE / (tn + fp) AS specificity, tn::DOUBLE / (tn + fn) AS npv FROM c)
SELECT tp, fp, fn, tn, {', '.join(f'round({c}, 6) AS {c}' for c in RATES[:5])}, {', '.join(
    f'round((1 + {b} * {b}) * precision * recall / ({b} * {b} * precision + recall), 6) AS {n}' for n, b in (('f1', 1), ('f2', 2), ('f05', 0.5)))} FROM r
""")
def _(spark, d):
    return rounded(e.binary_metrics(_scored(spark, d), "pred", "label"), *RATES, places=6)


@query("auc", f"""
WITH {SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM s GROUP BY 1),
c AS (SELECT *, sum(q) OVER (ORDER BY score) - q AS below, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp FROM g)
SELECT round(sum(p * (below + q / 2.0::DOUBLE)) / (sum(p) * sum(q)), 6) AS auc_roc, round(sum(p * tp::DOUBLE / (tp + fp)) / sum(p), 6) AS auc_pr FROM c
""")
def _(spark, d):
    return rounded(e.auc(_scored(spark, d), "score", "label"), "auc_roc", "auc_pr", places=6)


@query("threshold_sweep", f"""
WITH {SCORED}, t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) r(i)),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= threshold) AS al,
  count(*) FILTER (label = 1) AS p, count(*) AS n FROM t, s GROUP BY 1),
m AS (SELECT threshold, coalesce(tp / nullif(al, 0), 0) AS precision, tp / p AS recall, al::DOUBLE / n AS alert_rate FROM c),
f AS (SELECT *, coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0) AS f_beta FROM m)
SELECT round(threshold, 2) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(alert_rate, 6) AS alert_rate,
 round(f_beta, 6) AS f_beta, row_number() OVER (ORDER BY f_beta DESC, threshold) = 1 AS best FROM f
""")
def _(spark, d):
    out = e.threshold_sweep(_scored(spark, d), "score", "label")
    return rounded(out, "precision", "recall", "alert_rate", "f_beta", places=6)


@query("blend_sweep", f"""
WITH {PRED}, t AS (SELECT unnest({[float(x) for x in e.BLEND_THRESHOLDS]})::DOUBLE AS threshold),
x AS (SELECT threshold, exp(CASE WHEN exp((a + b) / 2) - 1 > threshold THEN greatest(a, b) ELSE least(a, b) END) - exp(y) AS err FROM p, t)
SELECT threshold, round(sqrt(avg(err * err)), 5) AS rmse, round(avg(abs(err)), 5) AS mae FROM x GROUP BY 1
""")
def _(spark, d):
    return rounded(e.blend_sweep(_pairs(spark, d), ["a", "b"], "y"), "rmse", "mae", places=5)


SEG = """count(*) AS n, round(avg(act), 5) AS mean_actual, round(avg(pr), 5) AS mean_pred, round(avg(abs(pr - act)), 5) AS mae,
 round(sqrt(avg((pr - act) * (pr - act))), 5) AS rmse, round(avg(pr - act), 5) AS bias, round(quantile_cont(pr - act, 0.5), 9) AS median_bias"""
ERR = f"WITH {PRED}, e AS (SELECT *, exp(a) - 1 AS pr, exp(y) - 1 AS act FROM p)"
SEG_COLS = ["mean_actual", "mean_pred", "mae", "rmse", "bias"]


def _segments(df):
    """Means at five places; medians of decimal inputs lie on decimal ties, so they keep nine."""
    return rounded(rounded(df, *SEG_COLS, places=5), "median_bias", places=9)


def _errors(spark, d):
    return e.with_errors(_pairs(spark, d), "a", "y")


@query("segment_errors", f"{ERR} SELECT l_returnflag, l_linestatus, {SEG} FROM e GROUP BY 1, 2")
def _(spark, d):
    return _segments(e.segment_errors(_errors(spark, d), ["l_returnflag", "l_linestatus"]))


def _severity(scheme, shift=0):
    """Bins of the quantity, moved down by ``shift`` so that early rows occur; the open bin last."""
    edges, labels = e.SEVERITY_BINS[scheme]
    ops = ["<" if scheme == "detailed" and not i else "<=" for i in range(len(edges))]
    cases = " ".join(f"WHEN act {o} {x} THEN '{y}'" for o, x, y in zip(ops, edges, labels))
    sql = f"""{ERR}, f AS (SELECT * REPLACE (round(act, 6) - {shift} AS act, pr - {shift} AS pr) FROM e),
 g AS (SELECT CASE {cases} ELSE '{labels[-1]}' END AS bin, {SEG} FROM f GROUP BY 1) SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct FROM g"""

    def run(spark, d):
        t = _errors(spark, d).withColumns({"actual_value": F.round("actual_value", 6) - shift, "pred_value": F.col("pred_value") - shift})
        t = t.withColumn("error", F.col("pred_value") - F.col("actual_value"))
        return rounded(_segments(e.severity_bins(t, scheme)), "pct", places=6)

    return sql, run


for _name, _scheme, _shift in (("severity_bins", "coarse", 0), ("severity_bins_detailed", "detailed", 10), ("severity_bins_status", "status", 10)):
    _sql, _run = _severity(_scheme, _shift)
    query(_name, _sql)(_run)


@query("worst_segments", f"""{ERR}, g AS (SELECT l_suppkey, {SEG} FROM e GROUP BY 1) SELECT * FROM g WHERE n >= 20 ORDER BY mae DESC, l_suppkey""")
def _(spark, d):
    seg = _segments(e.segment_errors(_errors(spark, d), ["l_suppkey"]))
    return e.worst_segments(seg, 20, ties=["l_suppkey"])


def _typed(spark, d):
    return e.error_types(_scored(spark, d), "pred", "label")


@query("error_types", f"""
WITH {SCORED} SELECT doc_id, CASE WHEN pred = 1 AND label = 1 THEN 'TP' WHEN pred = 0 AND label = 0 THEN 'TN' WHEN pred = 1 THEN 'FP' ELSE 'FN' END AS error_type FROM s
""")
def _(spark, d):
    return _typed(spark, d).select("doc_id", "error_type")


@query("errors_by", f"""
WITH {SCORED}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 0 AND label = 0) AS tn,
 count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn FROM s GROUP BY 1),
r AS (SELECT *, (tp + tn)::DOUBLE / n AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall,
 fn::DOUBLE / nullif(tp + fn, 0) AS miss_rate, fp::DOUBLE / nullif(tn + fp, 0) AS false_alarm_rate FROM c)
SELECT lang, n, tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(miss_rate, 6) AS miss_rate,
 round(false_alarm_rate, 6) AS false_alarm_rate, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM r
""")
def _(spark, d):
    out = e.errors_by(_typed(spark, d), ["lang"])
    return rounded(out, "accuracy", "precision", "recall", "miss_rate", "false_alarm_rate", "f1", places=6)


def _profile(spark, d):
    t = _typed(spark, d).withColumn("size", F.col("n_chars").cast("double")).withColumn("guess", F.col("score") * 5000)
    return e.miss_profile(t, "size", "guess", [1000, 3000], ["small", "medium", "large"], [2000], ["low", "high"])


PROFILE = f"WITH {SCORED}, t AS (SELECT s.*, n_chars::DOUBLE AS size, score * 5000 AS guess FROM s JOIN documents USING (doc_id))"


@query("miss_profile_recall", f"""{PROFILE} SELECT CASE WHEN size < 1000 THEN 'small' WHEN size < 3000 THEN 'medium' ELSE 'large' END AS band,
 count(*) AS n, count(*) FILTER (pred = 1) AS found, round(avg(size), 5) AS mean_actual, round(avg(guess), 5) AS mean_pred,
 round(count(*) FILTER (pred = 1)::DOUBLE / count(*), 6) AS recall FROM t WHERE label = 1 GROUP BY 1""")
def _(spark, d):
    return rounded(rounded(_profile(spark, d)["recall"], "mean_actual", "mean_pred", places=5), "recall", places=6)


@query("miss_profile_false_positives", f"""{PROFILE} SELECT CASE WHEN guess < 2000 THEN 'low' ELSE 'high' END AS band, count(*) AS n,
 round(avg(size), 5) AS mean_actual, round(avg(guess), 5) AS mean_pred FROM t WHERE label = 0 AND pred = 1 GROUP BY 1""")
def _(spark, d):
    return rounded(_profile(spark, d)["false_positives"], "mean_actual", "mean_pred", places=5)


@query("miss_profile_missed", f"""{PROFILE} SELECT count(*) AS n, round(avg(size), 5) AS mean, min(size) AS min, max(size) AS max,
 round(quantile_cont(size, 0.5), 5) AS median, round(quantile_cont(size, 0.9), 5) AS p90 FROM t WHERE label = 1 AND pred = 0""")
def _(spark, d):
    return rounded(_profile(spark, d)["missed"], "mean", "median", "p90", places=5)


IC = f"""WITH {BARS}, f AS (SELECT bar, close AS pred, lead(close) OVER (PARTITION BY event_type ORDER BY bar) AS target FROM bars),
k AS (SELECT bar, rank() OVER (PARTITION BY bar ORDER BY pred) + (count(*) OVER (PARTITION BY bar, pred) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY bar ORDER BY target) + (count(*) OVER (PARTITION BY bar, target) - 1) / 2.0::DOUBLE AS b FROM f WHERE target IS NOT NULL),
i AS (SELECT bar, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY 1 HAVING count(*) >= 4)"""


def _ic(spark, d):
    t = b._frame(_bars(spark, d), ["event_type"], "bar", 0, 1, lambda w: {"target": F.lead("close").over(w)})
    return e.information_coefficient(t, "bar", "close", "target", 4)


@query("information_coefficient", f"""{IC} SELECT count(ic) AS instants, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic,
 round(avg((ic > 1e-12)::INT), 6) AS positive_share, round(avg(ic) / stddev_samp(ic), 6) AS ir FROM i WHERE ic IS NOT NULL AND NOT isnan(ic)""")
def _(spark, d):
    return rounded(_ic(spark, d)[1], "mean_ic", "std_ic", "positive_share", "ir", places=6)


@query("information_coefficient_by_instant", f"{IC} SELECT bar, n, round(ic, 6) AS ic FROM i WHERE ic IS NOT NULL AND NOT isnan(ic)")
def _(spark, d):
    return rounded(_ic(spark, d)[0], "ic", places=6)


@query("ols_diagnostics", """
WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, count(*) AS n, var_pop(x) AS vx FROM t),
g AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(mx) AS mx, any_value(vx) AS vx, any_value(n) AS n, sum(e * e) AS ss, sum(e * e) AS w00, sum(e * e * (x - mx)) AS w01,
 sum(e * e * (x - mx) * (x - mx)) AS w11 FROM (SELECT *, y - b0 - b1 * x AS e FROM t, r))
SELECT 'intercept' AS term, round(b0, 4) AS estimate, round(sqrt(ss / (n - 2) * (1.0 / n + mx * mx / (n * vx))), 4) AS std_error,
 round(sqrt(n::DOUBLE / (n - 2) * (w00 / n / n - 2 * mx * w01 / (n * n * vx) + mx * mx * w11 / (n * n * vx * vx))), 4) AS hc1_error FROM g
UNION ALL SELECT 'l_quantity', round(b1, 4), round(sqrt(ss / (n - 2) / (n * vx)), 4), round(sqrt(n::DOUBLE / (n - 2) * w11 / (n * n * vx * vx)), 4) FROM g
""")
def _(spark, d):
    out = e.ols_diagnostics(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])["terms"]
    return rounded(out.select("term", "estimate", "std_error", "hc1_error"), "estimate", "std_error", "hc1_error")


@query("ols_fit", """
WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM t),
q AS (SELECT x, y, (y - b0 - b1 * x) * (y - b0 - b1 * x) AS e2 FROM t, r)
SELECT count(*) AS n, round(regr_r2(y, x), 6) AS r2, round(sqrt(sum(e2) / (count(*) - 2)), 3) AS sigma, round(count(*) * pow(corr(x, e2), 2), 4) AS breusch_pagan FROM q
""")
def _(spark, d):
    out = e.ols_diagnostics(load(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])["fit"].drop("bp_p")
    return rounded(rounded(rounded(out, "r2", places=6), "sigma", places=3), "breusch_pagan")


@query("ols_multiple")
def _(spark, d):
    t = load(spark, d, "lineitem").withColumn("log_price", F.ln("l_extendedprice"))
    train, later = (t.filter(F.col("l_shipdate") < "1999-01-01"), t.filter(F.col("l_shipdate") >= "1999-01-01"))
    return e.ols_diagnostics(train, "log_price", ["l_quantity", "l_discount", "l_tax"], later)["terms"]
