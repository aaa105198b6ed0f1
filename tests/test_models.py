"""Model steps: fixed seeds, better than the mean, folds without overlap."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluate, models


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(600).select(
        "id",
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("x"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") / 4).cast("int")).alias("day"),
    )
    y = F.col("x") * 2 + F.when(F.col("k") == "a", 3.0).otherwise(0.0)
    return base.withColumn("y", y).withColumn("flag", (F.col("x") > 5).cast("int")).cache()


def test_fits_beat_the_mean(rows):
    spread = rows.agg(F.stddev_pop("y")).first()[0]
    for name in ("linear", "tree"):
        fitted = models.fit_regressor(rows, name, ["k"], ["x"], "y").transform(rows)
        assert models.rmse(fitted, "y") < spread / 2
    scored = models.with_probability(models.fit_classifier(rows, "logistic", ["k"], ["x"], "flag").transform(rows))
    assert evaluate.auc(scored, "prob", "flag").first()["auc_roc"] > 0.95


def test_folds_are_ordered_and_disjoint(rows):
    for maker in (models.expanding_folds, models.rolling_folds):
        for fold in maker(rows, "day", 3):
            train, val = models.fold_frames(rows, "day", fold)
            assert train.agg(F.max("day")).first()[0] < val.agg(F.min("day")).first()[0]
            assert train.count() and val.count()


def test_grid_search_prefers_the_better_setting(rows):
    folds = models.expanding_folds(rows, "day", 1)
    results = models.grid_search(
        rows, "day", folds, {"regParam": [0.0, 50.0]},
        lambda p: models.model_pipeline("regression", "linear", ["k"], ["x"], "y", **p),
        lambda df: models.rmse(df, "y"),
    )
    assert "0.0" in models.best_parameters(results).first()["params"]


def test_two_stage_and_importance(rows):
    out = models.two_stage(rows, rows, ["k"], ["x"], "flag", "y", maxDepth=4)
    assert out.filter((F.col("pred_flag") == 0) & (F.col("prediction") != 0)).count() == 0
    model = models.fit_regressor(rows, "tree", ["k"], ["x"], "y", maxDepth=4)
    top = models.feature_importance(model, model.transform(rows)).first()
    assert top["feature"] == "x"
