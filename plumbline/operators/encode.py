"""Encoders and scalers: learned on training rows, applied to any rows."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import columns_of
from .frames import rejoin
from .report import cardinality_report


def fit_target_encoding(train: DataFrame, cols: list[str], label: str, m: float = 100.0) -> dict:
    """Smoothed label means per level: (n x mean + m x global) / (n + m)."""
    overall = train.agg(F.avg(label)).first()[0]
    tables = {
        c: train.groupBy(c)
        .agg(F.count(label).alias("_n"), F.sum(label).alias("_s"))
        .select(c, ((F.coalesce("_s", F.lit(0.0)) + m * overall) / (F.col("_n") + m)).alias(f"{c}_encoded"))
        for c in cols
    }
    return {"global": overall, "tables": tables}


def apply_target_encoding(df: DataFrame, spec: dict) -> DataFrame:
    """Levels never seen in training get the global mean."""
    for c, table in spec["tables"].items():
        df = rejoin(df, table, [c])
    return df.fillna(spec["global"], subset=[f"{c}_encoded" for c in spec["tables"]])


def target_encode(
    train: DataFrame, apply: DataFrame, cols: list[str], label: str, m: float = 100.0
) -> DataFrame:
    return apply_target_encoding(apply, fit_target_encoding(train, cols, label, m))


def encode_pipeline(
    categorical: list[str], numeric: list[str], scale: bool = False, output: str = "features"
) -> Pipeline:
    """Index (unseen levels kept apart) + one-hot + assemble, optionally scaled."""
    stages = []
    if categorical:
        indexed, hot = [f"{c}_idx" for c in categorical], [f"{c}_vec" for c in categorical]
        stages += [
            StringIndexer(
                inputCols=categorical, outputCols=indexed, handleInvalid="keep",
                stringOrderType="frequencyDesc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep"),
        ]
    else:
        hot = []
    raw = f"{output}_raw" if scale else output
    stages.append(VectorAssembler(inputCols=[*hot, *numeric], outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=output))
    return Pipeline(stages=stages)


# Cardinality limits between the encoders.
ONE_HOT_MIN, ONE_HOT_MAX = 3, 30


def route_encoders(
    df: DataFrame, cols: list[str], one_hot: list[str] = (), target: list[str] = ()
) -> DataFrame:
    """Encoder per column by number of levels, overridden by the two lists; ``required`` tells
    which override applied, ``missing`` rows name override columns the table lacks."""
    card = cardinality_report(df, cols).select("column", "distinct_values")
    n = F.col("distinct_values")
    route = (
        F.when(F.col("column").isin(*(target or [""])), "target")
        .when(F.col("column").isin(*(one_hot or [""])), "one_hot")
        .when(n == 2, "binary")
        .when(n > ONE_HOT_MAX, "target")
        .when(n >= ONE_HOT_MIN, "one_hot")
        .otherwise("none")
    )
    overrides = [*one_hot, *target] or [""]
    out = card.select("column", n, route.alias("route"), F.col("column").isin(*overrides).alias("required"))
    absent = [c for c in [*one_hot, *target] if c not in cols]
    if not absent:
        return out
    lost = df.sparkSession.createDataFrame(
        [(c, None, "missing", True) for c in absent], out.schema
    )
    return out.unionByName(lost)


def route_scalers(
    df: DataFrame, label: str, robust: list[str], minmax: list[str], skip: list[str] = ()
) -> dict[str, list[str]]:
    """Scaler group per numeric column. A column with a ``_log`` twin leaves the robust group."""
    numeric = [c for c in columns_of(df, T.NumericType) if c != label]
    twins = {c[: -len("_log")] for c in numeric if c.endswith("_log")}
    usable = [c for c in numeric if c not in skip]
    groups = {
        "skipped": [c for c in numeric if c in skip],
        "robust": [c for c in robust if c in usable and c not in twins],
        "minmax": [c for c in minmax if c in usable],
    }
    taken = {*groups["robust"], *groups["minmax"]}
    groups["standard"] = [c for c in usable if c not in taken]
    return groups


def scaler_pipeline(groups: dict[str, list[str]]) -> Pipeline:
    """One vector per non-empty group, scaled by its scaler into ``scaled_<group>``."""
    kinds = {"robust": RobustScaler, "minmax": MinMaxScaler, "standard": StandardScaler}
    stages = []
    for name, kind in kinds.items():
        if groups.get(name):
            stages.append(
                VectorAssembler(inputCols=groups[name], outputCol=f"raw_{name}", handleInvalid="keep")
            )
            extra = {"withMean": True} if name == "standard" else {}
            stages.append(kind(inputCol=f"raw_{name}", outputCol=f"scaled_{name}", **extra))
    return Pipeline(stages=stages)
