"""Exact quantiles and ranks without gathering a column in one buffer.

Values are counted per distinct value, prefix counts are built bucket by bucket
(``frames.running``), and only the rows that hold a wanted rank go on. The bucket is a monotone
function of the value, so it needs no sampling pass and never differs between retries; a bucket that
turns out crowded is cut along its own range of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage
from . import frames
from .frames import col, finite, inside, rejoin, running

_STEPS = 4096  # buckets per power of two in magnitude
_LOWEST = -1000  # exponents below share their buckets


def value_bucket(x: Column) -> Column:
    """Non-decreasing long in ``x``: equal steps inside each power of two, mirrored around zero, so tiny and huge
    values are told apart alike. NaN sorts last."""
    exponent = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(_LOWEST))
    step = F.floor((F.abs(x) / F.pow(F.lit(2.0), exponent) - 1) * F.lit(_STEPS))
    size = F.when(x == 0, F.lit(0)).otherwise((exponent - (_LOWEST - 2)) * F.lit(_STEPS) + step + 1)
    return (
        F.when(F.isnan(x), F.lit(1 << 40))
        .when(F.abs(x) == float("inf"), F.signum(x) * F.lit(1 << 39))
        .otherwise(F.signum(x) * size)
        .cast("long")
    )


def unpivoted(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Long form ``(*keys, metric, value double)`` without nulls."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    return (
        df.select(*keys, F.explode(pairs).alias("_m"))
        .select(*keys, "_m.metric", "_m.value")
        .filter(F.col("value").isNotNull())
    )


def value_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values with ``n``, rows strictly below (``below``) and group total (``total``)."""
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(
        counts, keys, value_bucket(F.col("value")), [F.col("value")], {"upto": ("sum", "n")}
    ).withColumn("below", F.col("upto") - F.col("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return rejoin(ranked, totals, keys).drop("upto")


def exact_quantiles(
    df: DataFrame, keys: list[str], cols: list[str], probs: list[float]
) -> DataFrame:
    """Interpolated quantiles in long form: ``(*keys, metric, prob, quantile)``.

    Rows are counted per value bucket first, which shuffles only bucket counts. A second pass then
    looks at the few buckets that hold a wanted rank and orders their distinct values; a bucket of more than
    ``frames.BUCKET_ROWS`` rows is cut along its own range before that, as often as it takes."""
    ks = [*keys, "metric"]
    long = unpivoted(df, keys, cols).withColumn("_b", value_bucket(F.col("value")))
    n, v = F.col("n"), F.col("value")
    at = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            F.floor(F.lit(float(p)) * (F.col("total") - 1)).cast("long").alias("lo"),
            F.ceil(F.lit(float(p)) * (F.col("total") - 1)).cast("long").alias("hi"),
            (F.lit(float(p)) * (F.col("total") - 1)).alias("at"),
        )
        for p in probs
    ]
    spans = [F.count(F.lit(1)).alias("n"), F.min(finite(v)).alias("v_lo"), F.max(finite(v)).alias("v_hi")]

    def held(a: Column, below: Column, count: Column) -> Column:
        def within(r: Column) -> Column:
            return (r >= below) & (r < below + count)

        return within(a["lo"]) | within(a["hi"])

    def holding(heads: DataFrame, asks: Column) -> DataFrame:
        kept = heads.select(*ks, "_b", "before", "n", "v_lo", "v_hi", F.filter(asks, lambda a: held(a, F.col("before"), n)).alias("asks"))
        return cut_lineage(kept.filter(F.size("asks") > 0))  # a row per group and wanted rank, read more than once

    group = W.partitionBy(*ks)
    heads = long.groupBy(*ks, "_b").agg(*spans).select(
        "*", (F.sum(n).over(group.orderBy("_b")) - n).alias("before"), F.sum(n).over(group).alias("total")
    )
    asked = holding(heads, F.array(*at))
    limit = frames.BUCKET_ROWS
    while not asked.filter((n > limit) & (F.col("v_lo") < F.col("v_hi"))).isEmpty():
        hits = rejoin(long, asked, [*ks, "_b"], how="inner")
        part = F.when(n > limit, inside(v, F.col("v_lo"), F.col("v_hi"), n, limit))
        hits = hits.select(*ks, "value", "before", "asks", F.struct("_b", part.alias("p")).alias("_b"))
        first = [F.first("before").alias("base"), F.first("asks").alias("asks")]
        bucket = W.partitionBy(*ks, F.col("_b._b")).orderBy("_b.p")
        heads = hits.groupBy(*ks, "_b").agg(*spans, *first).withColumn("before", F.col("base") + F.sum(n).over(bucket) - n)
        asked = holding(heads, F.col("asks"))
        long = hits.select(*ks, "value", "_b")
    near = rejoin(long, asked.select(*ks, "_b", "before", "asks"), [*ks, "_b"], how="inner")
    values = near.groupBy(*ks, "_b", "value").agg(
        F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("asks").alias("asks")
    )
    upto = F.sum(n).over(W.partitionBy(*ks, "_b").orderBy("value"))
    ranked = values.select(*ks, "value", "n", "asks", (F.col("before") + upto - n).alias("below"))
    hits = ranked.select(
        *ks, "value", "n", "below", F.explode(F.filter("asks", lambda a: held(a, F.col("below"), n))).alias("a")
    )

    def value_at(r: str) -> Column:
        mine = (F.col(r) >= F.col("below")) & (F.col(r) < F.col("below") + n)
        return F.max(F.when(mine, F.col("value")))

    picked = hits.groupBy(*ks, F.col("a.prob").alias("prob")).agg(
        value_at("a.lo").alias("v_lo"), value_at("a.hi").alias("v_hi"), F.max(F.col("a.at") - F.col("a.lo")).alias("part")
    )
    return picked.select(
        *ks, "prob", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("part")).alias("quantile")
    )


def quantile_columns(
    df: DataFrame, keys: list[str], named: dict[str, tuple[str, float]]
) -> DataFrame:
    """One row per ``keys`` with ``{name: (column, prob)}`` as columns."""
    cols = list(dict.fromkeys(c for c, _ in named.values()))
    probs = list(dict.fromkeys(p for _, p in named.values()))
    long = exact_quantiles(df, keys, cols, probs)
    return long.groupBy(*keys).agg(
        *[
            F.max(
                F.when((F.col("metric") == c) & (F.col("prob") == F.lit(float(p))), F.col("quantile"))
            ).alias(name)
            for name, (c, p) in named.items()
        ]
    )


def quantile_values(df: DataFrame, named: dict[str, tuple[str, float]]) -> dict[str, float]:
    """Whole-table quantiles as plain numbers (one short row comes to the driver)."""
    return quantile_columns(df, [], named).first().asDict()


def with_quantiles(
    stats: DataFrame, df: DataFrame, keys: list[str], named: dict[str, tuple[str, float]]
) -> DataFrame:
    """Grouped ``stats`` widened by exact quantiles of ``df``."""
    return rejoin(stats, quantile_columns(df, keys, named), keys)


def average_ranks(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Add the tie-averaged 1-based rank of ``column`` within ``keys`` and the count ``<name>_n``
    of ranked rows; nulls stay unranked."""
    long = df.select(*keys, col(column).cast("double").alias("value")).filter("value is not null")
    counts = value_counts(long, keys).select(
        *keys,
        "value",
        (F.col("below") + (F.col("n") + 1) / 2).alias(name),
        F.col("total").alias(f"{name}_n"),
    )
    tagged = df.withColumn("value", col(column).cast("double"))
    return rejoin(tagged, counts, [*keys, "value"]).drop("value")


def group_mode(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Most frequent value per group, the smallest one on ties; counted per value first."""
    counts = df.filter(col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(name))
