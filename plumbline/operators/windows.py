"""Leak-safe history features. Every frame ends before the current row unless asked otherwise,
and runs through ``frames``, so hot keys are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import (
    DAY, col, days, micros, per_group, rejoin, row_frame, running, seconds, slice_of, tick_frame,
)
from .joins import asof_join

GLOBAL_RATE = 0.21  # fixed value: fallback rate where a key has no history


def _by_time(ts: str, ties: list[str] = ()) -> list[Column]:
    return [micros(ts), *[F.col(c) for c in ties]]


def _day_bucket(ts: str) -> Column:
    return slice_of(micros(ts), DAY * 1000000)


# --- trailing frames --------------------------------------------------------------------------


def trailing_stats(
    df: DataFrame, part: list[str], ts: str, lo: int, hi: int, aggs: dict[str, tuple[str, object]],
    ratios: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Aggregates over ``[ts+lo, ts+hi]`` seconds within ``part`` (for example -86400, -7200), and
    ratios of two of them."""
    out = tick_frame(df, part, seconds(ts), lo, hi, aggs)
    return out.withColumns(
        {n: F.col(a) / F.nullif(F.col(b), F.lit(0)) for n, (a, b) in (ratios or {}).items()}
    )


def trailing_days(
    df: DataFrame, part: list[str], day: str, n: int, kind: str, column, name: str,
    include_current: bool = False, fallback: float | None = GLOBAL_RATE,
) -> DataFrame:
    """One aggregate over the last ``n`` days. Means fall back to the partition mean of the same
    column, then to ``fallback``."""
    hi = 0 if include_current else -1
    lo = -(n - 1) if include_current else -n
    out = tick_frame(df, part, days(day), lo, hi, {name: (kind, column)})
    if kind != "avg":
        return out
    whole = per_group(out.withColumn("_x", col(column)), part, {"_all": F.avg("_x")})
    return whole.withColumn(
        name, F.coalesce(F.col(name), F.col("_all"), F.lit(fallback))
    ).drop("_x", "_all")


def prior_period_rate(
    df: DataFrame, key: list[str], day: str, label: Column, name: str, default: float = GLOBAL_RATE
) -> DataFrame:
    """Rate of the previous active day of the key. Days are aggregated first, so rows of the same
    day never see each other."""
    base = df.withColumn("_d", days(day))
    daily = base.groupBy(*key, "_d").agg(F.avg(label.cast("double")).alias("_r"))
    prior = daily.select(*key, "_d", F.lag("_r").over(W.partitionBy(*key).orderBy("_d")).alias(name))
    return rejoin(base, prior, [*key, "_d"]).withColumn(name, F.coalesce(name, F.lit(default))).drop("_d")


def frequency(
    df: DataFrame, key: list[str], day: str, label: Column, n: int = 30, tag: str = ""
) -> DataFrame:
    """Events, positives and rate in the ``[-n, -1]`` days before the row."""
    out = tick_frame(
        df, key, days(day), -n, -1,
        {f"{tag}events": ("count", F.lit(1)), f"{tag}positives": ("count", F.when(label, 1))},
    )
    rate = F.col(f"{tag}positives") / F.nullif(F.col(f"{tag}events"), F.lit(0))
    return out.withColumn(f"{tag}rate", rate)


def magnitude(
    df: DataFrame, key: list[str], day: str, label: Column, size: str, n: int = 30
) -> DataFrame:
    """Mean and maximum size of positives in the ``[-n, -1]`` days before the row."""
    hit = F.when(label, F.col(size))
    return tick_frame(df, key, days(day), -n, -1, {"avg_size": ("avg", hit), "max_size": ("max", hit)})


def congestion(
    df: DataFrame, site: list[str], ts: str, flags: dict[str, Column], span: int = 7200,
    include_current: bool = False,
) -> DataFrame:
    """Counts of flagged rows at a site in the trailing ``span`` seconds."""
    aggs = {n: ("count", F.when(c, 1)) for n, c in flags.items()}
    return tick_frame(df, site, seconds(ts), -span, 0 if include_current else -1, aggs)


# --- running and lagged values ----------------------------------------------------------------


def so_far_today(
    df: DataFrame, key: list[str], ts: str, label: Column, ties: list[str]
) -> DataFrame:
    """Earlier rows and positives of the same key and day, and the smoothed ratio
    (positives + 0.5) / (rows + 1)."""
    dated = df.withColumn("_day", days(ts))
    hour = slice_of(micros(ts), 3600 * 1000000)
    out = running(
        dated, [*key, "_day"], hour, _by_time(ts, ties),
        {"prior_rows": ("count", F.lit(1)), "prior_positives": ("count", F.when(label, 1))},
        include_current=False,
    ).drop("_day")
    share = (F.col("prior_positives") + 0.5) / (F.col("prior_rows") + 1)
    return out.withColumn("prior_ratio", share)


def history_ratio(
    df: DataFrame, keys: list[str], ts: str, value: str, ties: list[str], k: int = 365
) -> DataFrame:
    """``value`` over the mean of the previous ``k`` rows with the same keys (weekday and hour, for
    example), the current row left out; 1.0 without history."""
    out = row_frame(
        df, keys, _day_bucket(ts), _by_time(ts, ties), k, 0,
        lambda w: {"history_mean": F.avg(value).over(w.rowsBetween(-k, -1))},
    )
    ratio = F.when(F.col("history_mean") > 0, F.col(value) / F.col("history_mean")).otherwise(1.0)
    return out.withColumn("history_ratio", ratio)


def previous_event(
    df: DataFrame, key: list[str], ts: str, cols: dict[str, str], ties: list[str]
) -> DataFrame:
    """Values of the row before, whatever they are, by ``{new: source}``."""
    named = {n: ("last", F.struct(F.col(c).alias("v"))) for n, c in cols.items()}
    out = running(df, key, _day_bucket(ts), _by_time(ts, ties), named, include_current=False)
    return out.withColumns({n: F.col(n)["v"] for n in cols})


def previous_event_features(
    df: DataFrame, key: list[str], ts: str, cols: dict[str, str], ties: list[str]
) -> DataFrame:
    """Lagged numeric values, hours since the previous row and a first-row flag; first rows get
    the means over all later rows."""
    lagged = previous_event(df, key, ts, {**cols, "_prev": ts}, ties)
    out = lagged.withColumns(
        {
            "hours_since_prev": (micros(ts) - micros("_prev")) / F.lit(3.6e9),
            "is_first": F.when(F.col("_prev").isNull(), 1).otherwise(0),
        }
    ).drop("_prev")
    filled = [*cols, "hours_since_prev"]
    means = out.filter("is_first = 0").agg(*[F.avg(c).alias(f"_m_{c}") for c in filled])
    return (
        rejoin(out, means, [])
        .withColumns({c: F.when(F.col("is_first") == 1, F.col(f"_m_{c}")).otherwise(F.col(c)) for c in filled})
        .drop(*[f"_m_{c}" for c in filled])
    )


def recency(
    df: DataFrame, key: list[str], day: str, label: Column, ties: list[str], default: int = 999
) -> DataFrame:
    """Days since the last earlier positive row of the key, over all prior rows. Rows of the same
    day do not count as earlier."""
    base = df.withColumn("_d", days(day))
    daily = base.groupBy(*key, "_d").agg(F.max(F.when(label, F.col("_d"))).alias("_hit"))
    seen = running(daily, key, slice_of(F.col("_d"), 365), [F.col("_d")],
                   {"_last": ("last", "_hit")}, include_current=False)
    out = rejoin(base, seen.select(*key, "_d", "_last"), [*key, "_d"])
    return out.withColumn(
        "days_since", F.coalesce(F.col("_d") - F.col("_last"), F.lit(default)).cast("int")
    ).drop("_d", "_last")


def swing(
    df: DataFrame, key: list[str], ts: str, cols: dict[str, float], ties: list[str], rows: int = 3
) -> DataFrame:
    """Range of each column over the current and the last ``rows`` rows, and a flag where any range
    exceeds its limit."""

    def exprs(w):
        f = w.rowsBetween(-rows, 0)
        return {f"{c}_swing": F.max(c).over(f) - F.min(c).over(f) for c in cols}

    out = row_frame(df, key, _day_bucket(ts), _by_time(ts, ties), rows, 0, exprs)
    return _rapid(out, cols)


def swing_time(df: DataFrame, key: list[str], ts: str, cols: dict[str, float], span: int) -> DataFrame:
    """``swing`` over the trailing ``span`` seconds instead of rows."""
    aggs = {}
    for c in cols:
        aggs |= {f"_hi_{c}": ("max", c), f"_lo_{c}": ("min", c)}
    out = tick_frame(df, key, seconds(ts), -span, 0, aggs)
    out = out.withColumns({f"{c}_swing": F.col(f"_hi_{c}") - F.col(f"_lo_{c}") for c in cols})
    return _rapid(out.drop(*aggs), cols)


def _rapid(df: DataFrame, cols: dict[str, float]) -> DataFrame:
    hit = F.lit(False)
    for c, limit in cols.items():
        hit = hit | (F.col(f"{c}_swing") > limit)
    return df.withColumn("rapid_change", F.when(hit, 1).otherwise(0))


def anomaly(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Value minus the mean of its group."""
    out = per_group(df, keys, {f"_m_{c}": F.avg(c) for c in cols})
    return out.withColumns({f"{c}_anomaly": F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(
        *[f"_m_{c}" for c in cols]
    )


def group_share(df: DataFrame, coarse: list[str], fine: list[str], name: str) -> DataFrame:
    """Rows of the fine group over rows of the coarse group + 1."""
    out = per_group(df, coarse, {"_c": F.count(F.lit(1))})
    out = per_group(out, fine, {"_f": F.count(F.lit(1))})
    return out.withColumn(name, F.col("_f") / (F.col("_c") + 1)).drop("_c", "_f")


# --- cutoff-safe history ----------------------------------------------------------------------


def cutoff_frozen_history(
    df: DataFrame, part: list[str], day: str, cutoff: str, n: int, label: Column, name: str
) -> DataFrame:
    """Mean of ``label`` over the last ``n`` days. Rows before ``cutoff`` look at the days before
    their own; rows from the cutoff on all see the ``n`` days before the cutoff, built from
    pre-cutoff rows only."""
    at = F.unix_date(F.to_date(F.lit(cutoff))).cast("long")
    base = df.withColumn("_d", days(day)).withColumn("_y", label.cast("double"))
    asked = F.least(F.col("_d"), at)
    history = base.filter(F.col("_d") < at)
    daily = history.groupBy(*part, F.col("_d").alias("_day")).agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
    asks = base.select(*part, asked.alias("_day")).distinct()
    grid = asks.join(daily, [*part, "_day"], "full_outer")
    w = W.partitionBy(*part).orderBy("_day").rangeBetween(-n, -1)
    framed = grid.select(*part, "_day", (F.sum("_s").over(w) / F.nullif(F.sum("_n").over(w), F.lit(0))).alias(name))
    out = rejoin(base.withColumn("_day", asked), framed, [*part, "_day"])
    return out.drop("_d", "_y", "_day")


def leakage_audit(df: DataFrame, part: list[str], day: str, cutoff: str, features: list[str]) -> DataFrame:
    """Spread of each feature per key from the cutoff on: a frozen feature has none."""
    later = df.filter(F.col(day) >= F.lit(cutoff).cast(df.schema[day].dataType))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    long = later.select(*part, F.explode(pairs).alias("p")).select(*part, "p.feature", "p.v")
    return long.groupBy(*part, "feature").agg(
        F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n")
    )


def future_rows(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Rows whose attached observation is later than the prediction time."""
    return df.agg(
        F.count_if(F.col(observed) > F.col(predicted)).alias("future"), F.count(observed).alias("matched")
    )
