"""Bars, returns, rolling statistics and cross-sections of one long table keyed by entity and
time. Per-entity frames are chunked by row count; per-instant statistics are two-phase groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import DAY, days, micros, number_rows, per_group, rejoin, row_frame, running, slice_of
from .quantiles import average_ranks


def rebar(
    df: DataFrame, key: list[str], ts: str, width: str, value: str, volume: Column | None = None,
    ties: list[str] = (), closed: str = "left", label: str = "left",
) -> DataFrame:
    """Tumbling bars: open, high, low, close, sum, mean, std and volume per key and window.

    ``closed="right"`` puts a row on a window edge into the window that ends there; ``label`` picks
    which edge names the bar."""
    t = F.col(ts)
    if closed == "right":
        t = t - F.expr("INTERVAL '0.000001' SECOND")
    w = F.window(t, width)
    order = F.struct(F.col(ts), *[F.col(c) for c in ties])
    volume = F.count(F.lit(1)) if volume is None else F.sum(volume)
    return df.groupBy(*key, w.alias("_w")).agg(
        F.min_by(value, order).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, order).alias("close"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        volume.alias("volume"),
    ).select(*key, F.col("_w.start" if label == "left" else "_w.end").alias("bar"),
             "open", "high", "low", "close", "total", "mean", "std", "volume")


def _frame(df: DataFrame, key: list[str], ts: str, before: int, after: int, exprs) -> DataFrame:
    """Row frame over entities; bars are unique per (key, ts)."""
    return row_frame(df, key, slice_of(micros(ts), 30 * DAY * 1000000), [micros(ts)], before, after, exprs)


def _within_day(df: DataFrame, key: list[str], ts: str, before: int, after: int, exprs) -> DataFrame:
    dated = df.withColumn("_day", days(ts))
    hour = slice_of(micros(ts), 3600 * 1000000)
    return row_frame(dated, [*key, "_day"], hour, [micros(ts)], before, after, exprs).drop("_day")


def returns(
    df: DataFrame, key: list[str], ts: str, price: str, n: int = 1, within_day: bool = False,
    names: tuple[str, str] = ("ret", "log_ret"),
) -> DataFrame:
    """Simple and log return over ``n`` bars; with ``within_day`` the first bars of a day have none."""
    p = F.col(price)

    def exprs(w):
        before = F.nullif(F.lag(price, n).over(w), F.lit(0.0))
        ratio = p / before
        return {names[0]: ratio - 1, names[1]: F.when(ratio > 0, F.ln(ratio))}

    frame = _within_day if within_day else _frame
    return frame(df, key, ts, n, 0, exprs)


def volume_change(
    df: DataFrame, key: list[str], ts: str, volume: str, name: str = "vol_change", within_day: bool = False
) -> DataFrame:
    """Volume over the previous volume; 0 where that is not a finite number."""

    def exprs(w):
        return {name: F.coalesce(F.col(volume) / F.nullif(F.lag(volume).over(w), F.lit(0)), F.lit(0.0))}

    return (_within_day if within_day else _frame)(df, key, ts, 1, 0, exprs)


def _stat(agg: str, c: Column, f) -> Column:
    return {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "max": F.max, "min": F.min}[agg](c).over(f)


def rolling(
    df: DataFrame, key: list[str], ts: str, specs: dict[str, tuple[str, str, int, int]],
    ratios: dict[str, tuple[str, str]] | None = None, within_day: bool = False,
) -> DataFrame:
    """``{name: (agg, column, n, min_periods)}`` over the last ``n`` rows, the current included;
    null below ``min_periods`` non-null values. ``ratios`` divide a column by a rolling one."""
    longest = max(n for _, _, n, _ in specs.values())

    def exprs(w):
        out = {}
        for name, (agg, c, n, least) in specs.items():
            f = w.rowsBetween(-n + 1, 0)
            out[name] = F.when(F.count(c).over(f) >= least, _stat(agg, F.col(c), f))
        return out

    out = (_within_day if within_day else _frame)(df, key, ts, longest - 1, 0, exprs)
    return out.withColumns({n: F.col(a) / F.nullif(F.col(b), F.lit(0)) for n, (a, b) in (ratios or {}).items()})


def rolling_z(df: DataFrame, key: list[str], ts: str, column: str, n: int, name: str) -> DataFrame:
    """(x - mean of n) / std of n over full windows only; null without spread."""
    c = F.col(column)

    def exprs(w):
        f = w.rowsBetween(-n + 1, 0)
        z = (c - F.avg(c).over(f)) / F.nullif(F.stddev_samp(c).over(f), F.lit(0.0))
        return {name: F.when(F.count(c).over(f) >= n, z)}

    return _frame(df, key, ts, n - 1, 0, exprs)


def volatility_burst(df: DataFrame, key: list[str], ts: str, column: str, n: int, name: str) -> DataFrame:
    """Std of the last ``n`` rows over the std of the ``n`` rows before them."""
    c = F.col(column)

    def exprs(w):
        now, then = w.rowsBetween(-n + 1, 0), w.rowsBetween(-2 * n + 1, -n)
        full = (F.count(c).over(now) >= n) & (F.count(c).over(then) >= n)
        burst = F.stddev_samp(c).over(now) / F.nullif(F.stddev_samp(c).over(then), F.lit(0.0))
        return {name: F.when(full, burst)}

    return _frame(df, key, ts, 2 * n - 1, 0, exprs)


def moving_averages(
    df: DataFrame, key: list[str], ts: str, price: str, sizes: tuple[int, ...] = (5, 10, 20)
) -> DataFrame:
    """Means over full windows of the last 5, 10 and 20 bars."""
    return rolling(df, key, ts, {f"ma_{n}": ("mean", price, n, n) for n in sizes})


def gap_return(df: DataFrame, key: list[str], ts: str, open_: str = "open", close: str = "close") -> DataFrame:
    """Open against the close before it."""

    def exprs(w):
        last = F.lag(close).over(w)
        return {"gap_return": (F.col(open_) - last) / F.nullif(last, F.lit(0.0))}

    return _frame(df, key, ts, 1, 0, exprs)


def session_vwap(
    df: DataFrame, key: list[str], ts: str, price: str = "close", volume: str = "volume"
) -> DataFrame:
    """Volume-weighted mean price of the day so far, and the distance of the price from it."""
    dated = df.withColumn("_day", days(ts))
    sums = {"_dv": ("sum", F.col(price) * F.col(volume)), "_v": ("sum", F.col(volume))}
    hour = slice_of(micros(ts), 3600 * 1000000)
    out = running(dated, [*key, "_day"], hour, [micros(ts)], sums)
    vwap = F.col("_dv") / F.nullif(F.col("_v"), F.lit(0))
    return out.withColumn("vwap", vwap).withColumn(
        "vwap_distance", (F.col(price) - F.col("vwap")) / F.nullif(F.col("vwap"), F.lit(0.0))
    ).drop("_dv", "_v", "_day")


# --- cross-sections ---------------------------------------------------------------------------


def cross_section_z(df: DataFrame, ts: str, cols: list[str]) -> DataFrame:
    """z-score of each column against all entities at the same instant; null without spread."""
    aggs = {}
    for c in cols:
        aggs |= {f"_m_{c}": F.avg(c), f"_s_{c}": F.stddev_samp(c)}
    out = per_group(df, [ts], aggs)
    return out.withColumns(
        {f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in cols}
    ).drop(*aggs)


def cross_section_rank(df: DataFrame, ts: str, column: str, name: str) -> DataFrame:
    """Percentile rank among entities at the same instant; ties share their mean rank and nulls
    have none."""
    out = average_ranks(df, [ts], column, "_r")
    return out.withColumn(name, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def sector_relative(df: DataFrame, ts: str, cluster: str, column: str) -> DataFrame:
    """Value minus the mean of its cluster at the same instant, and the z-score within it."""
    out = per_group(df, [ts, cluster], {"_m": F.avg(column), "_s": F.stddev_samp(column)})
    gap = F.col(column) - F.col("_m")
    return out.withColumns(
        {f"{column}_vs_sector": gap, f"{column}_sector_z": gap / F.nullif(F.col("_s"), F.lit(0.0))}
    ).drop("_m", "_s")


def forward_target(df: DataFrame, key: list[str], ts: str, column: str, name: str = "target") -> DataFrame:
    """Next value of the same day, and its percentile rank at this instant."""
    out = _within_day(df, key, ts, 0, 1, lambda w: {name: F.lead(column).over(w)})
    return cross_section_rank(out, ts, name, f"{name}_rank")


# --- funds ------------------------------------------------------------------------------------


def common_period(prices: DataFrame, entity: str, date: str) -> DataFrame:
    """Rows inside the period that every entity covers."""
    spans = prices.groupBy(entity).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    bounds = spans.agg(F.max("a").alias("_from"), F.min("b").alias("_to"))
    return rejoin(prices, bounds, []).filter(F.col(date).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def fund_performance(
    prices: DataFrame, entity: str, date: str, price: str, per_year: float = 252, start: float = 100.0
) -> DataFrame:
    """Per entity over the common period: final value, total and annualised return, volatility,
    Sharpe ratio and maximum drawdown in percent, and whether it is the best or worst.

    A date without a price carries the last one forward, that is, adds a zero return; these dates
    enter through their count, so the date x entity grid is never built."""
    rows = common_period(prices, entity, date)
    bucket = slice_of(days(date), 365)
    dates = number_rows(rows.select(date).distinct(), [], bucket, [F.col(date)], "_no")
    n_dates = dates.agg(F.max("_no").alias("_n"))
    steps = running(rows, [entity], bucket, [F.col(date)], {"_before": ("last", price)}, include_current=False)
    steps = running(steps, [entity], bucket, [F.col(date)], {"_peak": ("max", price)})
    r = F.col(price) / F.nullif(F.col("_before"), F.lit(0.0)) - 1
    per = steps.groupBy(entity).agg(
        F.min_by(price, date).alias("_first"),
        F.max_by(price, date).alias("_last"),
        F.min(date).alias(date),
        F.sum(r).alias("_s"),
        F.sum(r * r).alias("_q"),
        F.min(F.col(price) / F.col("_peak") - 1).alias("_dd"),
    )
    per = rejoin(rejoin(per, dates, [date]), n_dates, [])
    k = (F.col("_n") - F.col("_no")).cast("double")
    growth = F.col("_last") / F.col("_first")
    annual = F.pow(growth, F.lit(float(per_year)) / F.col("_n")) - 1
    vol = F.sqrt((F.col("_q") - F.col("_s") * F.col("_s") / k) / F.nullif(k - 1, F.lit(0.0))) * float(per_year) ** 0.5
    out = per.select(
        entity,
        (growth * start).alias("final_value"),
        ((growth - 1) * 100).alias("total_return"),
        (annual * 100).alias("annual_return"),
        (vol * 100).alias("annual_vol"),
        (annual / F.nullif(vol, F.lit(0.0))).alias("sharpe"),
        (F.col("_dd") * 100).alias("max_drawdown"),
    )
    ends = out.agg(
        F.max_by(entity, "total_return").alias("_best"), F.min_by(entity, "total_return").alias("_worst")
    )
    standing = F.when(F.col(entity) == F.col("_best"), "best").when(F.col(entity) == F.col("_worst"), "worst")
    return rejoin(out, ends, []).withColumn("standing", standing).drop("_best", "_worst")


def fund_curve(prices: DataFrame, entity: str, date: str, price: str, start: float = 100.0) -> DataFrame:
    """Value of ``start`` invested at the beginning of the common period."""
    rows = common_period(prices, entity, date)
    firsts = rows.groupBy(entity).agg(F.min_by(price, date).alias("_first"))
    return rejoin(rows, firsts, [entity]).select(
        entity, date, (F.col(price) / F.col("_first") * start).alias("value")
    )
