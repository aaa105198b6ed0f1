"""Blending, metrics, sweeps and error slices. Thresholds are folded into bins and swept on the
bin totals, so a sweep is one pass whatever its length."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as fn
from ..functions.derive import band
from .frames import col, rejoin, running
from .quantiles import average_ranks, exact_quantiles, quantile_columns, value_bucket, with_quantiles
from .report import ratio

BACK = F.expm1  # predictions and labels in log units go back through exp(x) - 1


# --- blends -----------------------------------------------------------------------------------


def blend(df: DataFrame, cols: list[str], weights: list[float] | None = None) -> DataFrame:
    """Average, weighted average, maximum and minimum of prediction columns."""
    cs = [F.col(c) for c in cols]
    weights = weights or [1.0 / len(cols)] * len(cols)
    total = sum(cs[1:], cs[0])
    weighted = sum((c * w for c, w in zip(cs[1:], weights[1:])), cs[0] * weights[0])
    return df.withColumns(
        {
            "pred_avg": total / len(cols),
            "pred_weighted": weighted,
            "pred_max": F.greatest(*cs),
            "pred_min": F.least(*cs),
        }
    )


def adaptive(size: Column, hi: Column, lo: Column, threshold: float) -> Column:
    return F.when(size > threshold, hi).otherwise(lo)


def adaptive_blend(df: DataFrame, cols: list[str], threshold: float = 30.0) -> DataFrame:
    """Maximum where the average prediction in original units exceeds ``threshold``, else minimum."""
    b = blend(df, cols)
    return b.withColumn(
        "pred_adaptive", adaptive(BACK(F.col("pred_avg")), F.col("pred_max"), F.col("pred_min"), threshold)
    )


class AdaptiveBlend(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``adaptive_blend`` as a persistable pipeline stage."""

    inputCols = Param(Params._dummy(), "inputCols", "prediction columns", TypeConverters.toListString)
    threshold = Param(Params._dummy(), "threshold", "size limit in original units", TypeConverters.toFloat)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, threshold=30.0, outputCol="pred_adaptive"):
        super().__init__()
        self._setDefault(threshold=30.0, outputCol="pred_adaptive")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        out = adaptive_blend(df, self.getOrDefault(self.inputCols), self.getOrDefault(self.threshold))
        return out.select(*df.columns, F.col("pred_adaptive").alias(self.getOrDefault(self.outputCol)))


def gate_predictions(df: DataFrame, prob: str, pred: str, threshold: float = 0.25) -> DataFrame:
    """Prediction where the probability passes, regression alone, and probability x prediction."""
    p = F.col(prob)
    return df.withColumns(
        {
            "pred_gated": F.when(p > threshold, F.col(pred)).otherwise(0.0),
            "pred_regression": F.col(pred),
            "pred_expected": p * F.col(pred),
        }
    )


def to_binary(
    df: DataFrame, pred: str, threshold: float = 15.0, ceiling: float = 120.0
) -> DataFrame:
    """Size in original units, class at ``threshold`` and a pseudo-probability clipped to [0, 1]."""
    size = BACK(F.col(pred))
    return df.withColumns(
        {
            "pred_size": size,
            "pred_class": F.when(size >= threshold, 1).otherwise(0),
            "pred_probability": F.least(F.greatest(size / ceiling, F.lit(0.0)), F.lit(1.0)),
        }
    )


# --- metrics ----------------------------------------------------------------------------------


def regression_metrics(
    df: DataFrame, pred: str, label: str, keys: list[str] = (), back_transform: bool = True
) -> DataFrame:
    """RMSE, MAE and p50 / p90 / p99 of the absolute error, in original units."""
    t = BACK if back_transform else (lambda c: c)
    e = df.select(*keys, (t(F.col(pred)) - t(F.col(label))).alias("e")).withColumn("a", F.abs("e"))
    base = e.groupBy(*keys).agg(
        F.count("e").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("a").alias("mae")
    )
    return with_quantiles(base, e, list(keys), {"p50": ("a", 0.5), "p90": ("a", 0.9), "p99": ("a", 0.99)})


def strategy_table(
    df: DataFrame, strategies: list[str], label: str, back_transform: bool = True
) -> DataFrame:
    """``regression_metrics`` for many prediction columns."""
    long = df.select(
        F.col(label).alias("_y"),
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).cast("double").alias("p")) for s in strategies])
        ).alias("s"),
    ).select("_y", "s.strategy", "s.p")
    return regression_metrics(long, "p", "_y", ["strategy"], back_transform)


def confusion(pred: str, label: str) -> dict[str, Column]:
    p, y = F.col(pred) == 1, F.col(label) == 1
    return {
        "tp": F.count_if(p & y), "fp": F.count_if(p & ~y), "fn": F.count_if(~p & y), "tn": F.count_if(~p & ~y),
    }


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = beta * beta
    return F.coalesce((1 + b) * precision * recall / F.nullif(b * precision + recall, F.lit(0.0)), F.lit(0.0))


def scores_of_confusion(df: DataFrame) -> DataFrame:
    """Rates from tp, fp, fn, tn; 0 where a denominator is empty."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(ratio(a.cast("double"), b), F.lit(0.0))

    out = df.withColumns(
        {
            "accuracy": share(tp + tn, tp + tn + fp + fn),
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "specificity": share(tn, tn + fp),
            "npv": share(tn, tn + fn),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": f_beta(p, r, 1), "f2": f_beta(p, r, 2), "f05": f_beta(p, r, 0.5)})


def binary_metrics(df: DataFrame, pred: str, label: str, keys: list[str] = ()) -> DataFrame:
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in confusion(pred, label).items()])
    return scores_of_confusion(counts)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact ROC area and average precision, from counts per distinct score and their prefixes."""
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q")
    )
    cum = running(per, [], value_bucket(F.col("s")), [F.col("s")], {"_p": ("sum", "p"), "_q": ("sum", "q")})
    totals = per.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    rows = rejoin(cum, totals, [])
    p, q = F.col("p"), F.col("q")
    p_under, q_under = F.col("_p") - p, F.col("_q") - q
    tp, fp = F.col("all_p") - p_under, F.col("all_q") - q_under
    return rows.agg(
        (F.sum(p * (q_under + q / 2)) / F.nullif(F.max(F.col("all_p") * F.col("all_q")), F.lit(0))).alias("auc_roc"),
        (F.sum(p * tp / F.nullif(tp + fp, F.lit(0))) / F.nullif(F.max("all_p"), F.lit(0))).alias("auc_pr"),
    )


# The default grids of the two sweeps.
DEFAULT_THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]
BLEND_THRESHOLDS = [0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 60, 75, 90, 120]


def threshold_sweep(
    df: DataFrame, score: str, label: str, grid: list[float] = DEFAULT_THRESHOLDS, beta: float = 2.0
) -> DataFrame:
    """Precision, recall, F-beta and alert rate at each threshold (score >= threshold), with the
    best one marked."""
    grid = sorted(float(t) for t in grid)
    passed = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid[1:]),
                 F.when(F.col(score) >= grid[0], 1).otherwise(0))
    bins = df.groupBy(passed.alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")
    )
    levels = F.array(*[F.lit(t) for t in grid])
    flagged = (
        bins.select(F.explode(F.slice(levels, F.lit(1), F.col("_b"))).alias("threshold"), "n", "pos")
        .groupBy("threshold")
        .agg(F.sum("n").alias("alerts"), F.sum("pos").alias("tp"))
    )
    totals = bins.agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p")).select(
        F.explode(levels).alias("threshold"), "_n", "_p"
    )
    rows = rejoin(totals, flagged, ["threshold"]).fillna(0, subset=["alerts", "tp"])
    zero = F.lit(0.0)
    out = rows.select(
        "threshold",
        F.coalesce(ratio(F.col("tp").cast("double"), F.col("alerts")), zero).alias("precision"),
        F.coalesce(ratio(F.col("tp").cast("double"), F.col("_p")), zero).alias("recall"),
        ratio(F.col("alerts").cast("double"), F.col("_n")).alias("alert_rate"),
    ).withColumn("f_beta", f_beta(F.col("precision"), F.col("recall"), beta))
    best = out.agg(F.max_by("threshold", F.struct("f_beta", -F.col("threshold"))).alias("_best"))
    return rejoin(out, best, []).withColumn("best", F.col("threshold") == F.col("_best")).drop("_best")


def blend_sweep(
    df: DataFrame, cols: list[str], label: str, thresholds: list[float] = BLEND_THRESHOLDS
) -> DataFrame:
    """RMSE and MAE of ``adaptive_blend`` at each threshold; each row is priced once as maximum and
    once as minimum."""
    grid = sorted(float(t) for t in thresholds)
    b = blend(df, cols)
    size, y = BACK(F.col("pred_avg")), BACK(F.col(label))
    above = sum((F.when(size > t, 1).otherwise(0) for t in grid[1:]), F.when(size > grid[0], 1).otherwise(0))
    hi, lo = BACK(F.col("pred_max")) - y, BACK(F.col("pred_min")) - y
    bins = b.select(above.alias("_b"), hi.alias("hi"), lo.alias("lo")).groupBy("_b").agg(
        F.count("hi").alias("n"),
        F.sum(F.col("hi") * F.col("hi")).alias("q_hi"), F.sum(F.abs("hi")).alias("a_hi"),
        F.sum(F.col("lo") * F.col("lo")).alias("q_lo"), F.sum(F.abs("lo")).alias("a_lo"),
    )
    levels = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    rows = bins.select("*", F.explode(levels).alias("l"))
    use_hi = F.col("_b") >= F.col("l.i")
    return rows.groupBy(F.col("l.threshold").alias("threshold")).agg(
        F.sqrt(F.sum(F.when(use_hi, F.col("q_hi")).otherwise(F.col("q_lo"))) / F.sum("n")).alias("rmse"),
        (F.sum(F.when(use_hi, F.col("a_hi")).otherwise(F.col("a_lo"))) / F.sum("n")).alias("mae"),
    )


# --- error slices -----------------------------------------------------------------------------


def with_errors(df: DataFrame, pred: str, label: str, back_transform: bool = True) -> DataFrame:
    t = BACK if back_transform else (lambda c: c)
    out = df.withColumns({"pred_value": t(F.col(pred)), "actual_value": t(F.col(label))})
    return out.withColumn("error", F.col("pred_value") - F.col("actual_value"))


def segment_errors(df: DataFrame, keys: list[str], median: bool = True) -> DataFrame:
    """Count, means, MAE, RMSE, bias and median bias per segment of a frame with errors."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("actual_value").alias("mean_actual"),
        F.avg("pred_value").alias("mean_pred"),
        F.avg(F.abs("error")).alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("error").alias("bias"),
    )
    return with_quantiles(base, df, keys, {"median_bias": ("error", 0.5)}) if median else base


# Upper edge and label of each bin of the actual size, then the label of what lies above. An edge
# belongs to its bin, but for the first one of "detailed".
SEVERITY_BINS = {
    "coarse": (
        [0, 15, 30, 60, 120],
        ["0: On-time (<=0)", "1: Short (1-15)", "2: Medium (16-30)", "3: Long (31-60)", "4: Very Long (61-120)", "5: Extreme (>120)"],
    ),
    "detailed": (
        [0, 0, 5, 10, 15, 20, 30, 45, 60, 90, 120, 180],
        ["00: Early (<0)", "01: On-time (0)", "02: 1-5 min", "03: 6-10 min", "04: 11-15 min", "05: 16-20 min", "06: 21-30 min",
         "07: 31-45 min", "08: 46-60 min", "09: 61-90 min", "10: 91-120 min", "11: 121-180 min", "12: >180 min"],
    ),
    "status": ([0, 15, 60], ["On-time", "Minor Delay", "Moderate Delay", "Severe Delay"]),
}


def severity_bin(actual: Column, scheme: str = "coarse") -> Column:
    edges, labels = SEVERITY_BINS[scheme]
    if scheme == "detailed":  # what is below the first edge stands apart from what lies on it
        return F.when(actual < edges[0], labels[0]).otherwise(band(actual, edges[1:], labels[1:], right_closed=True))
    return band(actual, edges, labels, right_closed=True)


def severity_bins(df: DataFrame, scheme: str = "coarse") -> DataFrame:
    """``segment_errors`` over bins of the actual size, with the share of all rows in percent."""
    out = segment_errors(df.withColumn("bin", severity_bin(F.col("actual_value"), scheme)), ["bin"])
    total = out.agg(F.sum("n").alias("_t"))
    return rejoin(out, total, []).withColumn("pct", F.col("n") * 100.0 / F.col("_t")).drop("_t")


def worst_segments(segments: DataFrame, min_count: int, metric: str = "mae", ties: list[str] = (), n: int | None = None) -> DataFrame:
    """Segments of at least ``min_count`` rows, worst first; all of them unless ``n`` is given."""
    ordered = segments.filter(F.col("n") >= min_count).orderBy(F.desc(metric), *ties)
    return ordered if n is None else ordered.limit(n)


def error_types(df: DataFrame, pred: str, label: str) -> DataFrame:
    p, y = F.col(pred) == 1, F.col(label) == 1
    kind = F.when(p & y, "TP").when(~p & ~y, "TN").when(p & ~y, "FP").when(~p & y, "FN")
    return df.withColumn("error_type", kind)


def errors_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per segment of a frame with ``error_type``: counts, precision, recall, F1, miss rate and
    false-alarm rate; null where undefined."""
    k = F.col("error_type")
    c = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(k == t).alias(t.lower()) for t in ("TP", "TN", "FP", "FN")],
    )
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    out = c.withColumns(
        {
            "accuracy": ratio(tp + tn, F.col("n")),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "miss_rate": ratio(fn, tp + fn),
            "false_alarm_rate": ratio(fp, tn + fp),
        }
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def miss_profile(df: DataFrame, size: str, pred_size: str, edges: list[float], labels: list[str],
                 fp_edges: list[float], fp_labels: list[str]) -> dict[str, DataFrame]:
    """Recall of true positives by actual size, bands of false positives by predicted size, and
    statistics of the missed rows."""
    positives = df.filter(F.col("error_type").isin("TP", "FN"))
    recall = positives.groupBy(band(F.col(size), edges, labels).alias("band")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("error_type") == "TP").alias("found"),
        F.avg(size).alias("mean_actual"),
        F.avg(pred_size).alias("mean_pred"),
    ).withColumn("recall", F.col("found") / F.col("n"))
    alarms = df.filter(F.col("error_type") == "FP").groupBy(
        band(F.col(pred_size), fp_edges, fp_labels).alias("band")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_actual"), F.avg(pred_size).alias("mean_pred"))
    missed = df.filter(F.col("error_type") == "FN")
    stats = missed.agg(
        F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean"), F.min(size).alias("min"), F.max(size).alias("max")
    )
    stats = with_quantiles(stats, missed, [], {"median": (size, 0.5), "p90": (size, 0.9)})
    return {"recall": recall, "false_positives": alarms, "missed": stats}


# --- rank correlation -------------------------------------------------------------------------


def information_coefficient(
    df: DataFrame, ts: str, pred: str, target: str, min_n: int
) -> tuple[DataFrame, DataFrame]:
    """Spearman correlation per instant with at least ``min_n`` pairs, and its mean, std, ratio and
    positive share (above rounding error)."""
    pairs = df.filter(F.col(pred).isNotNull() & F.col(target).isNotNull())
    ranked = average_ranks(average_ranks(pairs, [ts], pred, "_a"), [ts], target, "_b")
    per = ranked.groupBy(ts).agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("ic"))
    per = per.filter((F.col("n") >= min_n) & F.col("ic").isNotNull() & ~F.isnan("ic"))
    summary = per.agg(
        F.count("ic").alias("instants"),
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("std_ic"),
        F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive_share"),
    ).withColumn("ir", F.col("mean_ic") / F.nullif(F.col("std_ic"), F.lit(0.0)))
    return per, summary


# --- linear regression diagnostics ------------------------------------------------------------


def ols_diagnostics(
    df: DataFrame, y: str, xs: list[str], holdout: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Ordinary least squares with classical and HC1 standard errors, Breusch-Pagan test, VIF and
    holdout error. Two aggregations of p x p sums; only these reach the driver."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in [y, *xs]]).dropna()
    cols = [*xs, y]
    moments = data.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i],
    ).first()
    n, p = moments["n"], len(xs)
    mean = np.array([moments[f"m{i}"] for i in range(p + 1)])
    cov = np.array([[moments[f"c{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    slopes = np.linalg.solve(cov[:p, :p], cov[:p, p])
    beta = np.concatenate([[mean[p] - slopes @ mean[:p]], slopes])

    fitted = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], xs):
        fitted = fitted + F.col(x) * F.lit(float(b))
    e2 = (F.col(y) - fitted) * (F.col(y) - fitted)
    # Regressors are centred, so that the sums below stay well conditioned.
    z = [F.lit(1.0), *[F.col(x) - F.lit(float(m)) for x, m in zip(xs, mean)]]
    second = data.withColumn("_e2", e2).agg(
        F.sum("_e2").alias("ss"),
        F.avg("_e2").alias("me2"),
        F.var_pop("_e2").alias("ve2"),
        *[F.covar_pop(F.col(x), F.col("_e2")).alias(f"g{i}") for i, x in enumerate(xs)],
        *[F.sum(z[i] * z[j] * F.col("_e2")).alias(f"w{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)],
    ).first()
    inner = np.array([[second[f"w{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    bread = np.zeros((p + 1, p + 1))
    bread[0, 0] = 1.0 / n
    bread[1:, 1:] = np.linalg.inv(cov[:p, :p]) / n
    shift = np.eye(p + 1)
    shift[0, 1:] = -mean[:p]  # back from centred to plain regressors
    dof = n - p - 1
    classic = shift @ (bread * second["ss"] / dof) @ shift.T
    robust = shift @ (bread @ inner @ bread * n / dof) @ shift.T
    corr = cov[:p, :p] / np.sqrt(np.outer(np.diag(cov)[:p], np.diag(cov)[:p]))
    vif = np.diag(np.linalg.inv(corr))
    g = np.array([second[f"g{i}"] for i in range(p)])
    bp = n * float(g @ np.linalg.solve(cov[:p, :p], g)) / second["ve2"] if second["ve2"] else 0.0
    r2 = 1 - second["ss"] / (cov[p, p] * n)

    se, hc1 = np.sqrt(np.diag(classic)), np.sqrt(np.diag(robust))
    rows = []
    for i, name in enumerate(["intercept", *xs]):
        t, tr = float(beta[i] / se[i]), float(beta[i] / hc1[i])
        rows.append(
            (name, float(beta[i]), float(se[i]), float(hc1[i]), t, fn.t_tail(t, dof), fn.t_tail(tr, dof),
             float(vif[i - 1]) if i else None)
        )
    spark = df.sparkSession
    terms = spark.createDataFrame(
        rows, "term string, estimate double, std_error double, hc1_error double, t double, p double,"
        " hc1_p double, vif double",
    )
    fit = spark.createDataFrame(
        [(n, float(r2), float(np.sqrt(second["ss"] / dof)), float(bp), fn.chi2_tail(bp, p))],
        "n long, r2 double, sigma double, breusch_pagan double, bp_p double",
    )
    out = {"terms": terms, "fit": fit}
    if holdout is not None:
        h = holdout.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
        err = h.select(F.col(y), (F.col(y) - fitted).alias("e"))
        out["holdout"] = err.agg(
            F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
            (1 - F.avg(F.col("e") * F.col("e")) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
            F.avg(F.abs("e")).alias("mae"),
        )
    return out
