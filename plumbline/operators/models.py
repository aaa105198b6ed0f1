"""Time-ordered folds, MLlib models, grid search and two-stage prediction."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.ml import Pipeline, classification as C, regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encode_pipeline
from .frames import days
from .quantiles import quantile_values
from .sampling import key_hash, HASH_RANGE

# --- folds ------------------------------------------------------------------------------------


def _cuts(df: DataFrame, order: str, parts: int) -> list[int]:
    """Day numbers that cut the rows into ``parts`` chunks; rows of one day stay together."""
    dated = df.select(days(order).alias("_d"))
    q = quantile_values(dated, {f"q{i}": ("_d", i / parts) for i in range(1, parts + 1)})
    return [int(q[f"q{i}"] // 1) for i in range(1, parts + 1)]


def expanding_folds(df: DataFrame, order: str, k: int) -> list[dict[str, int]]:
    """``k`` folds: train on everything up to a cut, validate on the next chunk."""
    c = _cuts(df, order, k + 1)
    return [
        {"fold": i + 1, "train_from": -(1 << 40), "train_to": c[i], "val_from": c[i] + 1, "val_to": c[i + 1]}
        for i in range(k)
    ]


def rolling_folds(df: DataFrame, order: str, k: int) -> list[dict[str, int]]:
    """As ``expanding_folds`` with one chunk of training rows each."""
    folds = expanding_folds(df, order, k)
    for previous, fold in zip(folds, folds[1:]):
        fold["train_from"] = previous["train_to"] + 1
    return folds


def fold_frames(df: DataFrame, order: str, fold: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    d = days(order)
    return (
        df.filter(d.between(fold["train_from"], fold["train_to"])),
        df.filter(d.between(fold["val_from"], fold["val_to"])),
    )


def fold_table(df: DataFrame, order: str, folds: list[dict[str, int]]) -> DataFrame:
    """Rows per fold and role from one pass."""
    d = days(order)
    spans = F.array(
        *[
            F.struct(
                F.lit(f["fold"]).alias("fold"), F.lit(role).alias("role"),
                F.lit(f[f"{role}_from"]).cast("long").alias("a"), F.lit(f[f"{role}_to"]).cast("long").alias("b"),
            )
            for f in folds
            for role in ("train", "val")
        ]
    )
    per_day = df.groupBy(d.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_day.select("_d", "_n", F.explode(spans).alias("s"))
        .filter("_d between s.a and s.b")
        .groupBy("s.fold", "s.role")
        .agg(F.sum("_n").alias("n"), F.min("_d").alias("first_day"), F.max("_d").alias("last_day"))
    )


def fold_weights(k: int, scheme: str = "equal", decay: float = 0.5) -> list[float]:
    """Weights of folds in time order: equal, linear or exponential."""
    if scheme == "equal":
        return [1.0] * k
    if scheme == "linear":
        return [float(i + 1) for i in range(k)]
    return [decay ** (k - 1 - i) for i in range(k)]


def weighted_score(results: DataFrame, fold: str, score: str, weights: list[float], keys: list[str] = ()) -> DataFrame:
    """Weighted mean score over folds 1..k."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.col(fold).cast("int"))
    return results.groupBy(*keys).agg((F.sum(F.col(score) * w) / F.sum(w)).alias("score"))


# --- models -----------------------------------------------------------------------------------

REGRESSORS = {
    "linear": R.LinearRegression,
    "tree": R.DecisionTreeRegressor,
    "forest": R.RandomForestRegressor,
    "gbt": R.GBTRegressor,
}
CLASSIFIERS = {
    "logistic": C.LogisticRegression,
    "tree": C.DecisionTreeClassifier,
    "forest": C.RandomForestClassifier,
    "gbt": C.GBTClassifier,
}


def _estimator(kinds: dict, name: str, label: str, weight: str | None, validation: str | None, params: dict):
    args = {"featuresCol": "features", "labelCol": label, **params}
    if weight:
        args["weightCol"] = weight
    if validation and name == "gbt":
        args["validationIndicatorCol"] = validation
    return kinds[name](**args)


def model_pipeline(
    task: str, name: str, categorical: list[str], numeric: list[str], label: str,
    weight: str | None = None, validation: str | None = None, **params,
) -> Pipeline:
    """Encoders plus one MLlib estimator; ``task`` is regression or classification."""
    kinds = REGRESSORS if task == "regression" else CLASSIFIERS
    head = _estimator(kinds, name, label, weight, validation, params)
    return Pipeline(stages=[*encode_pipeline(categorical, numeric).getStages(), head])


def fit_regressor(train: DataFrame, name: str, categorical, numeric, label: str, **kw):
    return model_pipeline("regression", name, categorical, numeric, label, **kw).fit(train)


def fit_classifier(train: DataFrame, name: str, categorical, numeric, label: str, **kw):
    return model_pipeline("classification", name, categorical, numeric, label, **kw).fit(train)


def with_probability(df: DataFrame, name: str = "prob", source: str = "probability") -> DataFrame:
    return df.withColumn(name, vector_to_array(source)[1])


def grid_search(
    df: DataFrame, order: str, folds: list[dict[str, int]], grid: dict[str, list],
    factory: Callable[[dict], Pipeline], metric: Callable[[DataFrame], float],
    sampler: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every parameter set on every fold: (params, fold, score). The sampled rows are the rows that
    are fitted, and one named metric is kept. Fold inputs are cached while in use."""
    sets = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    rows = []
    for fold in folds:
        train, val = fold_frames(df, order, fold)
        if sampler:
            train = sampler(train)
        train, val = train.persist(), val.persist()
        try:
            for params in sets:
                scored = factory(params).fit(train).transform(val)
                rows.append((str(sorted(params.items())), fold["fold"], float(metric(scored))))
        finally:
            train.unpersist()
            val.unpersist()
    return df.sparkSession.createDataFrame(rows, "params string, fold int, score double")


def best_parameters(results: DataFrame, smaller_is_better: bool = True) -> DataFrame:
    means = results.groupBy("params").agg(F.avg("score").alias("score"))
    order = F.asc("score") if smaller_is_better else F.desc("score")
    return means.orderBy(order, "params").limit(1)


def rmse(df: DataFrame, label: str, pred: str = "prediction") -> float:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(pred) - F.col(label), 2)))).first()[0]


def two_stage(
    train: DataFrame, apply: DataFrame, categorical, numeric, flag: str, size: str,
    classifier: str = "tree", regressor: str = "tree", **kw,
) -> DataFrame:
    """Classify, regress on the positives only, and predict zero elsewhere."""
    stage1 = fit_classifier(train, classifier, categorical, numeric, flag, **kw)
    stage2 = fit_regressor(train.filter(F.col(flag) == 1), regressor, categorical, numeric, size, **kw)
    helpers = [c for c in ("features", "rawPrediction", "probability") ]
    scored = stage1.transform(apply).withColumnRenamed("prediction", "pred_flag")
    scored = with_probability(scored).drop(*helpers, *[f"{c}_idx" for c in categorical], *[f"{c}_vec" for c in categorical])
    sized = stage2.transform(scored).withColumnRenamed("prediction", "pred_size_raw")
    return sized.withColumn(
        "prediction", F.when(F.col("pred_flag") == 1, F.col("pred_size_raw")).otherwise(0.0)
    ).select(*apply.columns, "prob", "pred_flag", "pred_size_raw", "prediction")


def feature_importance(model, transformed: DataFrame, features: str = "features") -> DataFrame:
    """Expanded feature names x importances, largest first, from the vector metadata."""
    meta = transformed.schema[features].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(names.get(i, str(i)), float(w)) for i, w in enumerate(weights)]
    return transformed.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


# Upper probability of the bins 1..4; the rest is bin 5.
SCORE_BINS = [0.1, 0.2, 0.3, 0.5]


def score_features(
    df: DataFrame, numeric: list[str], label: str, key: list[str], fraction: float = 0.1, top: int = 3,
    weighted_above: float = 0.1, seed: int = 42,
) -> DataFrame:
    """Probability of a small forest as a feature, its bin, and copies of the leading features
    scaled by ten times their importance. The forest learns on a hash sample; every row is scored."""
    filled = df.fillna(0, subset=numeric)
    sample = filled.filter(key_hash(key, seed) < int(fraction * HASH_RANGE))
    assembler = VectorAssembler(inputCols=numeric, outputCol="_features")
    forest = C.RandomForestClassifier(
        featuresCol="_features", labelCol=label, numTrees=5, maxDepth=5, seed=seed,
        predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw",
    )
    model = Pipeline(stages=[assembler, forest]).fit(sample)
    scored = with_probability(model.transform(filled), "forest_prob", "_prob")
    binned = F.lit(len(SCORE_BINS) + 1)
    for i, upper in reversed(list(enumerate(SCORE_BINS, 1))):
        binned = F.when(F.col("forest_prob") < upper, i).otherwise(binned)
    ranked = sorted(zip(model.stages[-1].featureImportances.toArray(), numeric), reverse=True)
    copies = {f"{c}_weighted": F.col(c) * float(w * 10) for w, c in ranked[:top] if w > weighted_above}
    return scored.withColumn("forest_bin", binned).withColumns(copies).drop("_features", "_pred", "_prob", "_raw")
