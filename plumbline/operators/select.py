"""Feature selection reports."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import f_tail
from .frames import rejoin
from .quantiles import average_ranks, quantile_values


def target_corr(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Pearson correlation of each column with the label from one pass, and absolute values
    normalised to weights."""
    one = df.agg(*[F.corr(c, label).alias(c) for c in cols])
    long = one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in cols])).alias("r")
    ).select("r.feature", "r.corr")
    total = long.agg(F.sum(F.abs("corr")).alias("_t"))
    return rejoin(long, total, []).select(
        "feature", "corr", (F.abs("corr") / F.nullif(F.col("_t"), F.lit(0.0))).alias("weight")
    )


def correlation_table(df: DataFrame, cols: list[str], method: str = "pearson") -> pd.DataFrame:
    """Columns x columns matrix; its size depends on the schema only."""
    data = df.select(*[F.col(c).cast("double") for c in cols]).dropna()
    vectors = VectorAssembler(inputCols=cols, outputCol="_v").transform(data)
    matrix = Correlation.corr(vectors, "_v", method).first()[0].toArray()
    return pd.DataFrame(matrix, index=cols, columns=cols)


def redundant_pairs(df: DataFrame, cols: list[str], label: str, threshold: float = 0.8) -> DataFrame:
    """Column pairs above ``threshold``, keeping the one closer to the label."""
    m = correlation_table(df, [*cols, label])
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            r = float(m.loc[a, b])
            if abs(r) > threshold:
                a_wins = abs(m.loc[a, label]) >= abs(m.loc[b, label])
                rows.append((a, b, r, a if a_wins else b, b if a_wins else a))
    schema = "feature_a string, feature_b string, corr double, keep string, drop string"
    return df.sparkSession.createDataFrame(rows, schema)


def rank_corr_compare(df: DataFrame, cols: list[str], label: str, margin: float = 0.05) -> DataFrame:
    """Pearson against Spearman per column; ``non_linear`` where rank correlation is clearly
    stronger. Ranks are tie-averaged and exact."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in [*cols, label]]).dropna()
    ranked = data
    for c in [*cols, label]:
        ranked = average_ranks(ranked, [], c, f"_r_{c}").drop(f"_r_{c}_n")
    one = ranked.agg(
        *[F.corr(c, label).alias(f"p_{c}") for c in cols],
        *[F.corr(f"_r_{c}", f"_r_{label}").alias(f"s_{c}") for c in cols],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"p_{c}").alias("pearson"), F.col(f"s_{c}").alias("spearman"))
            for c in cols
        ]
    )
    gap = F.abs(F.col("spearman") - F.col("pearson"))
    stronger = F.abs("spearman") > F.abs("pearson")
    return one.select(F.inline(rows)).select(
        "*",
        gap.alias("difference"),
        F.when(stronger, "Spearman").otherwise("Pearson").alias("stronger"),
        (stronger & (gap > margin)).alias("non_linear"),
    )


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(a, b, c) for a, b, c in zip(f, df1, df2)], dtype="float64")


def anova_f(
    df: DataFrame, categorical: list[str], numeric: str, alpha: float = 0.05
) -> DataFrame:
    """One-way F of ``numeric`` over each categorical column with at least two levels."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in categorical]
    )
    per_level = (
        df.select(F.explode(pairs).alias("p"), F.col(numeric).cast("double").alias("y"))
        .filter("y is not null and p.level is not null")
        .groupBy("p.feature", "p.level")
        .agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    )
    means = per_level.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"))
    sums = rejoin(per_level, means, ["feature"]).groupBy("feature").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("_mean"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    ).filter(F.col("groups") >= 2)
    df1, df2 = (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")
    f = (F.col("between") / df1) / F.nullif(F.col("within") / F.nullif(df2, F.lit(0.0)), F.lit(0.0))
    return sums.select("feature", "groups", "n", f.alias("f"), df1.alias("_a"), df2.alias("_b")).select(
        "feature", "groups", "n", "f", _f_tail("f", "_a", "_b").alias("p_value")
    ).withColumn("significant", F.col("p_value") < alpha)


def duplicate_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Groups of numerically identical columns: equal value signatures first, then a row by row
    comparison of the pairs that collide. Returns (column, same_as)."""
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column string, same_as string")
    signs = df.agg(
        *[
            F.struct(
                F.bit_xor(F.xxhash64(F.col(c).cast("double"), F.lit(1))),
                F.bit_xor(F.shiftrightunsigned(F.xxhash64(F.col(c).cast("double"), F.lit(2)), 20) * F.pmod(F.xxhash64(F.col(c).cast("double")), F.lit(1 << 19))),
                F.count(c),
            ).alias(c)
            for c in cols
        ]
    ).first()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :] if signs[a] == signs[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, same_as string")
    differ = df.agg(
        *[
            F.count_if(~F.col(a).cast("double").eqNullSafe(F.col(b).cast("double"))).alias(f"d{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("column"), F.lit(a).alias("same_as"), F.col(f"d{i}").alias("d"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    same = differ.select(F.inline(rows)).filter("d = 0")
    return same.groupBy("column").agg(F.min("same_as").alias("same_as"))


def threshold_flags(
    df: DataFrame, label: str, rules: dict[str, tuple[str, float, str]], train: DataFrame | None = None
) -> DataFrame:
    """Extreme flags from quantiles of the positive rows, and their correlation-weighted score.

    ``rules``: ``{flag: (column, prob, ">=" | "<=")}``. Thresholds and weights are learned on
    ``train``."""
    source = df if train is None else train
    levels = quantile_values(source.filter(F.col(label) == 1), {f: (c, p) for f, (c, p, _) in rules.items()})

    def flagged(x: DataFrame) -> DataFrame:
        return x.withColumns(
            {
                f: F.when(F.col(c) >= levels[f] if op == ">=" else F.col(c) <= levels[f], 1).otherwise(0)
                for f, (c, _, op) in rules.items()
            }
        )

    corr = flagged(source).agg(*[F.corr(label, f).alias(f) for f in rules]).first()
    raw = {f: abs(corr[f]) if corr[f] else 0.25 for f in rules}
    total = sum(raw.values())
    score = reduce(Column.__add__, [F.col(f) * F.lit(w / total) for f, w in raw.items()])
    return flagged(df).withColumn("extreme_score", score)


def log_candidates(df: DataFrame, cols: list[str]) -> list[str]:
    """Right-skewed (above 2), non-negative columns with more than two values, not yet logged."""
    cols = [c for c in cols if "log" not in c.lower()]
    if not cols:
        return []
    row = df.agg(
        *[F.skewness(c).alias(f"k_{c}") for c in cols],
        *[F.min(c).alias(f"m_{c}") for c in cols],
        *[F.approx_count_distinct(c).alias(f"d_{c}") for c in cols],
    ).first()
    return [
        c for c in cols
        if row[f"k_{c}"] is not None and row[f"k_{c}"] > 2 and row[f"m_{c}"] >= 0 and row[f"d_{c}"] > 2
    ]


def add_log_twins(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_log": F.log1p(c) for c in log_candidates(df, cols)})


def selection_report(
    df: DataFrame, numeric: list[str], categorical: list[str], label: str, threshold: float = 0.95
) -> DataFrame:
    """Every feature with KEEP or DROP and the reasons: redundant, duplicate, insignificant."""
    spark = df.sparkSession
    drops = redundant_pairs(df, numeric, label, threshold).select(
        F.col("drop").alias("feature"), F.lit("redundant").alias("reason")
    ).unionByName(
        duplicate_columns(df, numeric).select(
            F.col("column").alias("feature"), F.lit("duplicate").alias("reason")
        )
    ).unionByName(
        anova_f(df, categorical, label).filter("not significant").select(
            "feature", F.lit("insignificant").alias("reason")
        )
    )
    reasons = drops.distinct().groupBy("feature").agg(
        F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons")
    )
    corr = target_corr(df, numeric, label).select("feature", "corr")
    names = spark.createDataFrame([(c,) for c in [*numeric, *categorical]], "feature string")
    out = rejoin(rejoin(names, corr, ["feature"]), reasons, ["feature"])
    return out.withColumn("advice", F.when(F.col("reasons").isNull(), "KEEP").otherwise("DROP"))
