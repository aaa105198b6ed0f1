"""Column selection, missing-data reports, row filters, de-duplication and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import cleaning as fc
from .frames import DAY, per_group, rejoin, seconds, tick_frame
from .quantiles import group_mode, quantile_columns, quantile_values

NUMERIC = (T.NumericType,)
FLOATING = (T.DoubleType, T.FloatType)


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


# --- columns ----------------------------------------------------------------------------------


def present(cols: list[str], df: DataFrame) -> list[str]:
    return [c for c in cols if c in df.columns]


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*present(cols, df))


def drop_roles(
    df: DataFrame, leakage: list[str], ids: list[str], keywords: list[str] = ()
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Remove post-event columns, identifiers and columns whose name contains a keyword."""
    by_word = [c for c in df.columns if any(k.lower() in c.lower() for k in keywords)]
    dropped = [c for c in df.columns if c in leakage or c in ids or c in by_word]
    kept = [c for c in df.columns if c not in dropped]
    return df.select(*kept), {"dropped": dropped, "remaining": kept}


def audit_types(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Columns whose type differs from ``expected``: actual type, the cast to apply and how many
    non-null values that cast would lose. One aggregation."""
    actual = {n: t for n, t in df.dtypes if n in expected and t != expected[n]}
    lost = [
        F.count_if(F.col(n).isNotNull() & _cast(df, n, expected[n]).isNull()).alias(n) for n in actual
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"),
                F.lit(t).alias("actual"),
                F.lit(expected[n]).alias("expected"),
                F.lit(f"try_cast({n} as {expected[n]})").alias("fix"),
                F.col(n).alias("lost_values"),
            )
            for n, t in actual.items()
        ]
    )
    if not actual:
        empty = "column string, actual string, expected string, fix string, lost_values long"
        return df.sparkSession.createDataFrame([], empty)
    return df.agg(*lost).select(F.inline(rows))


def _cast(df: DataFrame, name: str, to: str) -> Column:
    """try_cast with a hop over timestamp where the pair has no direct cast."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType) and to not in ("string", "date", "timestamp"):
        return F.col(name).cast("timestamp").try_cast(to)
    return F.col(name).try_cast(to)


# --- reports on missing data ------------------------------------------------------------------


def _per_column(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One aggregation, then one row per column: ``(column, missing, total, pct)``."""
    totals = df.agg(F.count(F.lit(1)).alias("_total"), *[m.alias(c) for c, m in measures.items()])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in measures]
    )
    return totals.select(F.explode(rows).alias("r"), "_total").select(
        "r.column",
        "r.missing",
        F.col("_total").alias("total"),
        (F.col("r.missing") * 100.0 / F.nullif(F.col("_total"), F.lit(0))).alias("pct"),
    )


def null_report(df: DataFrame) -> DataFrame:
    """Nulls per column, most missing first."""
    measures = {c: F.count_if(F.col(c).isNull()) for c in df.columns}
    return _per_column(df, measures).orderBy(F.desc("missing"), "column")


def missing_report(df: DataFrame, stage: str) -> DataFrame:
    """As ``null_report`` with NaN counted as missing in floating columns."""
    floats = set(columns_of(df, *FLOATING))
    measures = {
        c: F.count_if(F.col(c).isNull() | F.isnan(c)) if c in floats else F.count_if(F.col(c).isNull())
        for c in df.columns
    }
    return _per_column(df, measures).select(F.lit(stage).alias("stage"), "*")


def drop_sparse(df: DataFrame, threshold: float, keep: list[str] = ()) -> DataFrame:
    """Drop columns whose null share exceeds ``threshold`` unless listed in ``keep``."""
    shares = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    ).first()
    total = max(shares["_total"], 1)
    return df.select(*[c for c in df.columns if c in keep or shares[c] / total <= threshold])


# --- rows -------------------------------------------------------------------------------------


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def required_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows before and after ``require``, and nulls per required column, from one pass."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols],
    )


def drop_where(df: DataFrame, flag: str | Column) -> DataFrame:
    """Remove rows whose flag equals 1; rows with an unknown flag stay."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return df.filter((c != 1) | c.isNull())


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. The rank limit is applied before the shuffle, so a
    hot key sends one row per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dedupe_ranked(
    df: DataFrame, keys: list[str], category: str, priority: list[str], order: list[Column]
) -> DataFrame:
    """Best row per key: categories in ``priority`` order, then ``order``; others come last."""
    rank = F.when(F.lit(False), 0)
    for i, value in enumerate(priority):
        rank = rank.when(F.col(category) == value, i)
    return dedupe(df, keys, [rank.otherwise(len(priority)).asc(), *order])


def validate_rows(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Split into valid rows and rejected rows with their ``reasons``. Rules per column: positive,
    non_negative, latitude, longitude, non_empty."""
    ok = {
        "positive": lambda c: c > 0,
        "non_negative": lambda c: c >= 0,
        "latitude": lambda c: c.between(-90, 90),
        "longitude": lambda c: c.between(-180, 180),
        "non_empty": lambda c: F.length(F.trim(c)) > 0,
    }
    reasons = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(ok[rule](F.col(c)), F.lit(False)), F.lit(f"{c}: {rule}"))
                for c, rule in rules.items()
            ]
        )
    )
    tagged = df.withColumn("reasons", reasons)
    return tagged.filter(F.size("reasons") == 0).drop("reasons"), tagged.filter(F.size("reasons") > 0)


# --- values -----------------------------------------------------------------------------------


def blank_to_null(df: DataFrame, tokens: tuple[str, ...] = fc.BLANK_TOKENS) -> DataFrame:
    return df.withColumns({c: fc.blank_to_null(F.col(c), tokens) for c in columns_of(df, T.StringType)})


def clip_to_null(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: fc.clip_to_null(F.col(c), lo, hi) for c, (lo, hi) in bounds.items()})


def replace_nonfinite(df: DataFrame, value: float | None) -> DataFrame:
    return df.withColumns({c: fc.finite_or(F.col(c), value) for c in columns_of(df, *FLOATING)})


def iqr_outliers(df: DataFrame, column: str, back_transform: bool = False) -> DataFrame:
    """p1..p99, quartile fences, and counts and share outside them, for one column.
    ``back_transform`` reports the levels through ``exp(x) - 1``."""
    q = quantile_values(
        df,
        {
            "p01": (column, 0.01),
            "q1": (column, 0.25),
            "median": (column, 0.5),
            "q3": (column, 0.75),
            "p99": (column, 0.99),
        },
    )
    spread = q["q3"] - q["q1"]
    low, high = q["q1"] - 1.5 * spread, q["q3"] + 1.5 * spread
    c = F.col(column)
    level = (lambda v: F.expm1(F.lit(v))) if back_transform else F.lit
    return df.agg(
        F.count(c).alias("n"),
        F.count_if(c < low).alias("n_low"),
        F.count_if(c > high).alias("n_high"),
    ).select(
        "*",
        ((F.col("n_low") + F.col("n_high")) * 100.0 / F.nullif(F.col("n"), F.lit(0))).alias("pct_outside"),
        *[level(v).alias(k) for k, v in q.items()],
        level(low).alias("fence_low"),
        level(high).alias("fence_high"),
    )


# --- imputation: fit on the training rows, apply to any ---------------------------------------


def fit_impute(train: DataFrame, how: dict[str, str]) -> dict[str, object]:
    """Fill values per column: ``median``, ``mode`` or ``constant:<text>``."""
    medians = {c: (c, 0.5) for c, h in how.items() if h == "median"}
    spec: dict[str, object] = quantile_values(train, medians) if medians else {}
    for c, h in how.items():
        if h == "mode":
            row = group_mode(train, [], c, "v").first()
            spec[c] = row["v"] if row else None
        elif h.startswith("constant:"):
            spec[c] = h.split(":", 1)[1]
    return spec


def apply_impute(df: DataFrame, spec: dict[str, object]) -> DataFrame:
    return df.fillna({c: v for c, v in spec.items() if v is not None})


def impute_global(df: DataFrame, how: dict[str, str], train: DataFrame | None = None) -> DataFrame:
    return apply_impute(df, fit_impute(df if train is None else train, how))


def impute_group(
    df: DataFrame, keys: list[str], column: str, how: str = "median", train: DataFrame | None = None
) -> DataFrame:
    """Fill nulls with the median or mode of their group; groups without a value stay null."""
    source = df if train is None else train
    if how == "median":
        fill = quantile_columns(source, keys, {"_fill": (column, 0.5)})
    else:
        fill = group_mode(source, keys, column, "_fill")
    return rejoin(df, fill, keys).withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def impute_tiered(
    df: DataFrame,
    part: list[str],
    ts: str,
    cols: list[str],
    span: int = DAY,
    train: DataFrame | None = None,
) -> DataFrame:
    """Actual value, else the mean of the trailing ``span`` seconds in the partition, else the
    global median of ``train``."""
    medians = quantile_values(df if train is None else train, {c: (c, 0.5) for c in cols})
    framed = tick_frame(df, part, seconds(ts), -span, 0, {f"_m_{c}": ("avg", c) for c in cols})
    return framed.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(medians[c])) for c in cols}
    ).drop(*[f"_m_{c}" for c in cols])


def impute_window_mean(df: DataFrame, part: list[str], column: str, source: str) -> DataFrame:
    """Null ``column`` becomes the mean of ``source`` in the partition."""
    return (
        per_group(df, part, {"_mean": F.avg(source)})
        .withColumn(column, F.coalesce(column, "_mean"))
        .drop("_mean")
    )
