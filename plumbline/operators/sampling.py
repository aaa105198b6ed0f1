"""Reproducible splits, folds, class balance and weights. Rows are chosen by the md5 of their key,
so a choice survives retries, repartitioning and added rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import band
from .clean import require
from .frames import number_rows, rejoin
from .quantiles import quantile_values

HASH_RANGE = 1 << 60


def key_hash(key: list[str], seed: int = 42) -> Column:
    """60-bit non-negative hash of the key columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _hash_rank(df: DataFrame, group: list[str], key: list[str], seed: int, name: str) -> DataFrame:
    """Row number within ``group`` in hash order, from 4,096 hash buckets per group and more where these are crowded."""
    hashed = df.withColumn("_h", key_hash(key, seed))
    bucket = F.shiftright("_h", 48)
    return number_rows(hashed, group, bucket, [F.col("_h"), *[F.col(k) for k in key]], name).drop("_h")


# --- splits -----------------------------------------------------------------------------------


def time_split(
    df: DataFrame, date: str, val_from: str, test_from: str, name: str = "split"
) -> DataFrame:
    """train / val / test by two date bounds."""
    kind = df.schema[date].dataType
    d = F.col(date)
    part = F.when(d < F.lit(val_from).cast(kind), "train").when(d < F.lit(test_from).cast(kind), "val")
    return df.withColumn(name, F.when(d.isNotNull(), part.otherwise("test")))


def hash_split(
    df: DataFrame, key: list[str], fractions: dict[str, float], strata: list[str] = (), seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Split by hash threshold, or with ``strata`` by position in hash order within each stratum,
    which gives every stratum its exact shares."""
    if strata:
        ranked = _hash_rank(df, list(strata), key, seed, "_rn")
        sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
        ranked = rejoin(ranked, sizes, list(strata))
        share = (F.col("_rn") - 1) / F.col("_n")
    else:
        ranked = df
        share = key_hash(key, seed) / F.lit(float(HASH_RANGE))
    names = list(fractions)
    chain, upper = F.when(F.lit(False), ""), 0.0
    for n in names[:-1]:
        upper += fractions[n]
        chain = chain.when(share < F.lit(round(upper, 12)), n)
    return ranked.withColumn(name, chain.otherwise(names[-1])).drop("_rn", "_n")


def stratified_folds(
    df: DataFrame, label: str, key: list[str], k: int, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """``k`` fold ids that differ by at most one row per class."""
    ranked = _hash_rank(df, [label], key, seed, "_rn")
    return ranked.withColumn(name, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


# --- class balance ----------------------------------------------------------------------------


def undersample(
    df: DataFrame, label: str, key: list[str], ratio: float = 1.0, seed: int = 42
) -> DataFrame:
    """Keep every row of the rarer class of a 0/1 label and enough of the other for
    ``minority / majority = ratio`` on average."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df
    major = max(counts, key=lambda c: (counts[c], str(c)))
    fraction = min(1.0, min(counts.values()) / counts[major] / ratio)
    limit = int(fraction * HASH_RANGE)
    return df.filter((F.col(label) != F.lit(major)) | (key_hash(key, seed) < F.lit(limit)))


def undersample_variants(
    df: DataFrame, label: str, key: list[str], ratios: list[float], seed: int = 42
) -> dict[float, DataFrame]:
    return {r: undersample(df, label, key, r, seed) for r in ratios}


def stratified_take(
    df: DataFrame, label: str, key: list[str], sizes: dict, seed: int = 42
) -> DataFrame:
    """Exactly ``sizes[class]`` rows of each listed class (or all it has), first in hash order."""
    ranked = _hash_rank(df.filter(F.col(label).isin(*sizes)), [label], key, seed, "_rn")
    wanted = reduce(
        Column.__or__, [(F.col(label) == F.lit(c)) & (F.col("_rn") <= n) for c, n in sizes.items()]
    )
    return ranked.filter(wanted).drop("_rn")


def class_weights(
    df: DataFrame, label: str, name: str = "class_weight", multipliers: dict | None = None
) -> DataFrame:
    """Balanced weight per class, rows / (classes x rows of the class), times a multiplier."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    weight = F.col("_t") / (F.col("_k") * F.col("n"))
    for c, m in (multipliers or {}).items():
        weight = F.when(F.col(label) == F.lit(c), weight * m).otherwise(weight)
    return rejoin(counts, totals, []).select(label, "n", weight.alias(name))


def with_class_weights(df: DataFrame, label: str, name: str = "class_weight", multipliers=None) -> DataFrame:
    return rejoin(df, class_weights(df, label, name, multipliers).drop("n"), [label])


def oversample_factors(
    df: DataFrame, label: str, cap: int = 50, majority=None
) -> DataFrame:
    """Copies per class: largest class over this class, rounded half to even, at most ``cap``; a
    named majority class gets 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("_top"))
    factor = F.least(F.bround(F.col("_top") / F.col("n")), F.lit(cap)).cast("int")
    if majority is not None:
        factor = F.when(F.col(label) == F.lit(majority), 1).otherwise(factor)
    return rejoin(counts, top, []).select(label, "n", factor.alias("factor"))


def oversample(df: DataFrame, label: str, cap: int = 50, majority=None) -> DataFrame:
    """Rows repeated by their class factor, numbered by ``copy``."""
    factors = oversample_factors(df, label, cap, majority).drop("n")
    return rejoin(df, factors, [label]).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("factor")))
    ).drop("factor")


# Upper size of a band and the row weight below it, then the weight above all.
MAGNITUDE_BANDS, MAGNITUDE_TOP = [(60.0, 1.0), (120.0, 2.0)], 2.5


def magnitude_weight(c: Column, bands=MAGNITUDE_BANDS, top: float = MAGNITUDE_TOP) -> Column:
    return band(c, [e for e, _ in bands], [F.lit(w) for _, w in bands] + [F.lit(top)], right_closed=True)


# --- quality tiers ----------------------------------------------------------------------------

# Tier limits and composite weights.
TIER_HIGH, TIER_HARD = 0.70, 0.50
HARD_WEIGHTS = (0.5, 0.3, 0.2)


def quality_filter(
    df: DataFrame, score: str, gates: list[str], parts: list[str], top: int, ties: list[str]
) -> DataFrame:
    """High-tier rows plus the best ``top`` hard cases.

    Hard cases lie between the tier limits, pass the lower quartile of every gate, and are ranked
    by the weighted sum of their min-max normalised ``parts``."""
    high = df.filter(F.col(score) >= TIER_HIGH).withColumn("tier", F.lit("high"))
    hard = df.filter((F.col(score) >= TIER_HARD) & (F.col(score) < TIER_HIGH))
    hard = require(hard, gates)
    q = quantile_values(hard, {g: (g, 0.25) for g in gates})
    if not q or any(v is None for v in q.values()):
        return high.withColumn("hard_score", F.lit(None).cast("double"))
    passed = hard.filter(reduce(Column.__and__, [F.col(g) >= q[g] for g in gates]))
    spans = passed.agg(
        *[F.min(p).alias(f"_lo_{p}") for p in parts], *[F.max(p).alias(f"_hi_{p}") for p in parts]
    )
    scaled = [(F.col(p) - F.col(f"_lo_{p}")) / (F.col(f"_hi_{p}") - F.col(f"_lo_{p}") + 1e-6) for p in parts]
    total = reduce(Column.__add__, [s * w for s, w in zip(scaled, HARD_WEIGHTS)])
    best = (
        rejoin(passed, spans, [])
        .withColumn("hard_score", total)
        .orderBy(F.desc("hard_score"), *ties)
        .limit(top)
        .select(*df.columns, F.lit("hard").alias("tier"), "hard_score")
    )
    return high.unionByName(best, allowMissingColumns=True)
