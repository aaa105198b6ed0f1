"""Aggregated reports. Every report is one grouped pass; quantiles are exact and come from
``quantiles``, which never gathers a group in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .clean import columns_of
from .frames import col, rejoin
from .joins import top_k
from .quantiles import exact_quantiles, quantile_columns, unpivoted, with_quantiles


def _n() -> Column:
    return F.count(F.lit(1))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


# --- rates and score cards --------------------------------------------------------------------


def rate_by(
    df: DataFrame, keys: list[str], label: str, value: str | None = None, min_count: int = 1
) -> DataFrame:
    """Count, positives and rate in percent per key; with ``value`` also mean, spread and p95.
    Groups below ``min_count`` are left out, highest rate first."""
    aggs = [_n().alias("n"), F.count_if(F.col(label) == 1).alias("positives")]
    if value:
        aggs += [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")]
    out = df.groupBy(*keys).agg(*aggs).filter(F.col("n") >= min_count)
    out = out.withColumn("rate_pct", ratio(F.col("positives") * 100.0, F.col("n")))
    if value:
        out = with_quantiles(out, df, keys, {"p95": (value, 0.95)})
    return out.orderBy(F.desc("rate_pct"), *keys)


def entity_scorecard(df: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """``rate_by`` for one entity with a consistency score, 100 / (1 + std / |mean|), and the
    on-time rate."""
    card = rate_by(df, [key], label, value)
    return card.withColumns(
        {
            "consistency": 100.0 / (1 + ratio(F.col("std"), F.abs("mean"))),
            "on_time_pct": 100.0 - F.col("rate_pct"),
        }
    )


def top_n(
    df: DataFrame, metric: str, n: int, rerank: str | None = None, ties: list[str] = ()
) -> DataFrame:
    """The ``n`` rows with the largest ``metric``, then sorted by ``rerank``."""
    best = df.orderBy(F.desc(metric), *ties).limit(n)
    return best.orderBy(F.desc(rerank), *ties) if rerank else best


def class_distribution(
    df: DataFrame, label: str, split: str, weight: str | None = None
) -> DataFrame:
    """Count and share of each class within each split, with the mean row weight."""
    aggs = [_n().alias("n")] + ([F.avg(weight).alias("mean_weight")] if weight else [])
    counts = df.groupBy(split, label).agg(*aggs)
    totals = counts.groupBy(split).agg(F.sum("n").alias("_t"))
    return rejoin(counts, totals, [split]).withColumn("pct", F.col("n") * 100.0 / F.col("_t")).drop("_t")


def transition_table(df: DataFrame, prev: str, cur: str) -> DataFrame:
    """Counts of (previous state, current state) and the share within the previous state."""
    counts = df.groupBy(prev, cur).agg(_n().alias("n"))
    totals = counts.groupBy(prev).agg(F.sum("n").alias("total"))
    return rejoin(counts, totals, [prev]).withColumn("pct", F.col("n") * 100.0 / F.col("total"))


# --- column profiles --------------------------------------------------------------------------

# Upper count of each size class, then the two open classes.
SIZE_CLASSES = [(2, "Binary"), (10, "Low (2-10)"), (50, "Medium (11-50)"), (100, "High (51-100)")]
SIZE_UNIQUE, SIZE_OPEN = "Extremely High (>50% unique)", "Very High (>100)"


def cardinality_report(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Distinct values, null share, distinct share and size class per column.

    Exact counts group the long form by value, so nothing is collected in one place; the
    approximate form is a single sketch aggregation."""
    if exact:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]
        )
        per_value = (
            df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.v").agg(_n().alias("n"))
        )
        out = per_value.groupBy("column").agg(
            F.count("v").alias("distinct_values"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.sum("n").alias("_total"),
        )
    else:
        aggs = [
            F.struct(
                F.lit(c).alias("column"),
                F.approx_count_distinct(c).alias("distinct_values"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                _n().alias("_total"),
            ).alias(c)
            for c in cols
        ]
        out = df.agg(*aggs).select(F.inline(F.array(*cols)))
    share = ratio(F.col("distinct_values").cast("double"), F.col("_total"))
    klass = F.when(F.lit(False), "")
    for upper, name in SIZE_CLASSES:
        klass = klass.when(F.col("distinct_values") <= upper, name)
    return out.select(
        "column",
        "distinct_values",
        "nulls",
        (F.col("nulls") * 100.0 / F.col("_total")).alias("null_pct"),
        share.alias("distinct_share"),
        klass.when(share > 0.5, SIZE_UNIQUE).otherwise(SIZE_OPEN).alias("size_class"),
    )


def dq_summary(df: DataFrame) -> DataFrame:
    """Type and null rate of every column; minimum, median and maximum of numeric ones."""
    numeric = columns_of(df, T.NumericType)
    rows = []
    for f in df.schema.fields:
        is_num = f.name in numeric
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.avg(F.col(f.name).isNull().cast("double")).alias("null_rate"),
                (F.min(f.name) if is_num else F.lit(None)).cast("double").alias("min"),
                (F.max(f.name) if is_num else F.lit(None)).cast("double").alias("max"),
            ).alias(f.name)
        )
    base = df.agg(*rows).select(F.inline(F.array(*df.columns)))
    medians = exact_quantiles(df, [], numeric, [0.5]).select(
        F.col("metric").alias("column"), F.col("quantile").alias("median")
    )
    return rejoin(base, medians, ["column"])


def quantiles(
    df: DataFrame, cols: list[str], probs: list[float], keys: list[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles, one row per (key, column, probability)."""
    return exact_quantiles(df, list(keys), cols, probs)


def mapping_check(df: DataFrame, a: str, b: str) -> DataFrame:
    """Violations of ``a -> b`` and ``b -> a``: keys that see more than one partner."""
    pairs = df.select(a, b).distinct()

    def side(x: str, y: str) -> DataFrame:
        return (
            pairs.groupBy(x)
            .agg(F.count(y).alias("partners"))
            .filter("partners > 1")
            .select(F.lit(f"{x} -> {y}").alias("mapping"), F.col(x).cast("string").alias("key"), "partners")
        )

    return side(a, b).unionByName(side(b, a))


def coverage_report(long: DataFrame, ts: Column, entity: str, thresholds: list[int]) -> dict[str, DataFrame]:
    """Entities per instant: the share of instants above each threshold, and the yearly mean."""
    per_ts = long.select(ts.alias("ts"), entity).distinct().groupBy("ts").agg(_n().alias("entities"))
    at = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.col(f"_c{t}").alias("instants"))
            for t in thresholds
        ]
    )
    shares = (
        per_ts.agg(_n().alias("_all"), *[F.count_if(F.col("entities") >= t).alias(f"_c{t}") for t in thresholds])
        .select(F.explode(at).alias("a"), "_all")
        .select("a.threshold", "a.instants", (F.col("a.instants") * 100.0 / F.col("_all")).alias("pct"))
    )
    yearly = per_ts.groupBy(F.year("ts").alias("year")).agg(F.avg("entities").alias("mean_entities"))
    return {"thresholds": shares, "yearly": yearly}


def check_scores(df: DataFrame, universe: DataFrame, ts: str, entity: str, score: str) -> DataFrame:
    """Per instant: scored entities inside the universe, null / NaN / infinite scores, pass flag."""
    known = universe.select(entity).distinct().withColumn("_known", F.lit(1))
    s = F.col(score)
    out = df.join(known, entity, "left").groupBy(ts).agg(
        F.count("_known").alias("valid"),
        F.count_if(s.isNull()).alias("nulls"),
        F.count_if(F.isnan(s)).alias("nans"),
        F.count_if(F.abs(s) == float("inf")).alias("infs"),
    )
    clean = (F.col("valid") > 0) & (F.col("nulls") + F.col("nans") + F.col("infs") == 0)
    return out.withColumn("passed", clean)


# --- text and list roll-ups -------------------------------------------------------------------


def ordered_concat(
    df: DataFrame, keys: list[str], text: str, order: list[str], sep: str = "\n", first: str | None = None
) -> DataFrame:
    """Texts of a group joined in ``order``, with the first value of ``first``. The joined text is
    one cell, so a group is as large as its own output row."""
    item = F.struct(*[F.col(o) for o in order], F.col(text).alias("_text"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_text"])
    aggs = [F.array_join(lines, sep).alias(text)]
    if first:
        aggs.append(F.min_by(first, F.struct(*order)).alias(first))
    return df.groupBy(*keys).agg(*aggs)


def distinct_sorted_concat(df: DataFrame, keys: list[str], value: str, sep: str = " ") -> DataFrame:
    unique = df.select(*keys, value).distinct()
    return unique.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(value)), sep).alias(value)
    )


def flatten_lists(df: DataFrame, keys: list[str], items: str, order: list[str]) -> DataFrame:
    """Lists of a group flattened into one, in ``order`` of their rows."""
    row = F.struct(*[F.col(o) for o in order], F.col(items).alias("_items"))
    lists = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_items"])
    return df.groupBy(*keys).agg(F.flatten(lists).alias(items))


# --- long and wide ----------------------------------------------------------------------------


def long_summary(df: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Mean, median, std, quartiles and n per group and metric."""
    base = unpivoted(df, group, metrics).groupBy(*group, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")
    )
    q = exact_quantiles(df, group, metrics, [0.25, 0.5, 0.75])
    wide = q.groupBy(*group, "metric").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
            for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))
        ]
    )
    return rejoin(base, wide, [*group, "metric"])


def pivot_metrics(long: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Row x column matrix of mean values; ``values`` fixes the columns, so no extra job runs."""
    return long.groupBy(row).pivot(column, values).agg(F.avg(value))


def melt(
    df: DataFrame, ids: list[str], cols: list[str], names: tuple[str, str] = ("variable", "value"),
    labels: dict[str, str] | None = None, max_chars: int | None = None, head: int | None = None,
) -> DataFrame:
    """Wide to long without null values.

    With ``labels`` values become trimmed texts (lists joined by commas, empty ones left out) and each row gets a
    ``label``: the given one, or the last part of the column's name in title case. ``max_chars`` shortens
    texts, the last character being an ellipsis. ``head`` keeps the first rows per ``ids`` in the order of ``cols``,
    numbered in ``position``."""
    variable, value = names
    if labels is None and max_chars is None:
        out = df.unpivot(ids, cols, *names).filter(F.col(value).isNotNull())
    else:
        types = dict(df.dtypes)
        texts = []
        for c in cols:
            x = F.col(f"`{c}`")
            if types[c].startswith("array"):
                parts = F.filter(F.transform(x, lambda v: F.trim(v.cast("string"))), lambda v: v != "")
                x = F.array_join(parts, ", ")
            texts.append(F.struct(F.lit(c).alias(variable), F.trim(x.cast("string")).alias(value)))
        out = df.select(*ids, F.inline(F.array(*texts))).filter(F.col(value) != "")
        if max_chars is not None:
            short = F.concat(F.substring(value, 1, max_chars - 1), F.lit("…"))
            out = out.withColumn(value, F.when(F.length(value) > max_chars, short).otherwise(F.col(value)))
        if labels is not None:
            told = {c: labels.get(c, c.split(".")[-1].replace("_", " ").title()) for c in cols}
            out = out.withColumn("label", _looked_up(F.col(variable), told))
    if head is None:
        return out
    place = _looked_up(F.col(variable), {c: i for i, c in enumerate(cols)})
    return top_k(out.withColumn("_place", place), ids, [F.col("_place")], head, "position").drop("_place")


def _looked_up(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


# --- comparisons ------------------------------------------------------------------------------


def delta_table(
    df: DataFrame, model: str, models: list[str], metrics: list[str], probs: tuple = (0.1, 0.5, 0.9)
) -> DataFrame:
    """Per metric: mean and quantiles of each model, and the differences of mean and median for
    each pair of models in order (later minus earlier)."""
    wanted = df.filter(F.col(model).isin(*models))
    means = unpivoted(wanted, [model], metrics).groupBy("metric").agg(
        *[F.avg(F.when(F.col(model) == m, F.col("value"))).alias(f"{m}_mean") for m in models]
    )
    q = exact_quantiles(wanted, [model], metrics, list(dict.fromkeys([*probs, 0.5])))
    levels = q.groupBy("metric").agg(
        *[
            F.max(
                F.when((F.col(model) == m) & (F.col("prob") == float(p)), F.col("quantile"))
            ).alias(f"{m}_p{round(p * 100)}")
            for m in models
            for p in dict.fromkeys([*probs, 0.5])
        ]
    )
    both = rejoin(means, levels, ["metric"])
    deltas = {}
    for i, a in enumerate(models):
        for b in models[i + 1 :]:
            deltas[f"mean_{b}_minus_{a}"] = F.col(f"{b}_mean") - F.col(f"{a}_mean")
            deltas[f"median_{b}_minus_{a}"] = F.col(f"{b}_p50") - F.col(f"{a}_p50")
    return both.withColumns(deltas)


def cohens_d(df: DataFrame, group: str, a, b, metrics: list[str]) -> DataFrame:
    """Standardised mean difference (b minus a) with pooled deviation; null below two values per
    side or without spread."""
    long = unpivoted(df.filter(F.col(group).isin(a, b)), [group], metrics)

    def arm(v):
        return F.when(F.col(group) == v, F.col("value"))

    s = long.groupBy("metric").agg(
        *[f(arm(v)).alias(f"{n}_{t}") for t, v in (("a", a), ("b", b))
          for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    )
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b")) / F.nullif(na + nb - 2, F.lit(0)))
    d = (F.col("m_b") - F.col("m_a")) / F.nullif(pooled, F.lit(0.0))
    return s.select("metric", F.when((na >= 2) & (nb >= 2), d).alias("cohens_d"))


def compare_groups(df: DataFrame, group: str, a, b, metrics: list[str]) -> DataFrame:
    """Mean, median and std of two arms per metric with difference (b minus a) and winner. The
    larger value wins, except for std, where the smaller one does."""
    s = long_summary(df.filter(F.col(group).isin(a, b)), [group], metrics)
    stats = F.array(
        *[F.struct(F.lit(n).alias("stat"), F.col(n).alias("v")) for n in ("mean", "median", "std")]
    )
    long = s.select(group, "metric", F.explode(stats).alias("s")).select(group, "metric", "s.stat", "s.v")
    wide = long.groupBy("metric", "stat").agg(
        F.max(F.when(F.col(group) == a, F.col("v"))).alias("a"),
        F.max(F.when(F.col(group) == b, F.col("v"))).alias("b"),
    )
    gain = F.when(F.col("stat") == "std", F.col("a") - F.col("b")).otherwise(F.col("b") - F.col("a"))
    winner = F.when(gain > 0, F.lit(str(b))).when(gain < 0, F.lit(str(a))).otherwise("Tie")
    return wide.withColumns({"diff": F.col("b") - F.col("a"), "winner": winner})


def win_table(a: DataFrame, b: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Per key: both values, the winner or a tie, the difference (first minus second) and the best."""
    x = a.select(key, F.col(value).alias(names[0]))
    y = b.select(key, F.col(value).alias(names[1]))
    p, q = F.col(names[0]), F.col(names[1])
    return x.join(y, key).select(
        key,
        *names,
        F.when(p > q, names[0]).when(q > p, names[1]).otherwise("Tie").alias("winner"),
        (p - q).alias("diff"),
        F.greatest(p, q).alias("best"),
    )


def win_counts(wins: DataFrame) -> DataFrame:
    return wins.groupBy("winner").agg(_n().alias("n"), F.avg(F.abs("diff")).alias("mean_margin"))


def win_extremes(wins: DataFrame, key: str, k: int, floor: float = 0.001) -> DataFrame:
    """Top and bottom ``k`` keys by best value; the bottom list skips keys at or below ``floor``."""
    top = wins.orderBy(F.desc("best"), key).limit(k).withColumn("list", F.lit("top"))
    low = wins.filter(F.col("best") > floor).orderBy("best", key).limit(k)
    return top.unionByName(low.withColumn("list", F.lit("bottom")))


def large_differences(wins: DataFrame, limit: float) -> DataFrame:
    return wins.filter(F.abs("diff") > limit).orderBy(F.desc(F.abs("diff")))


# Lower limit of each score band; below the last one a score counts as zero.
SCORE_BANDS = [("excellent", 0.85), ("good", 0.70), ("fair", 0.50), ("poor", 0.001)]


def score_bands(df: DataFrame, group: str, score: str) -> DataFrame:
    """Rows per band and arm, with zero and missing scores counted apart."""
    s = F.col(score)
    known = s.isNotNull() & ~F.isnan(s)
    aggs, upper = [], None
    for name, low in SCORE_BANDS:
        inside = known & (s >= low) & (s < upper if upper is not None else F.lit(True))
        aggs.append(F.count_if(inside).alias(name))
        upper = low
    zero = F.count_if(known & (s < SCORE_BANDS[-1][1])).alias("zero")
    return df.groupBy(group).agg(*aggs, zero, F.count_if(~known).alias("nan"))


def failure_causes(
    df: DataFrame, score: str, parts: dict[str, str], missing_ok: list[str] = (), floor: float = 0.001,
    part_floor: float = 0.01,
) -> DataFrame:
    """Rows with a zero score and the list of causes: ``parts`` maps a column to its cause, which
    applies below ``part_floor``; a missing part also counts unless listed in ``missing_ok``."""
    causes = []
    for c, cause in parts.items():
        low = F.col(c) < part_floor
        if c not in missing_ok:
            low = low | F.col(c).isNull() | F.isnan(c)
        causes.append(F.when(low, F.lit(cause)))
    found = F.array_compact(F.array(*causes))
    return df.filter(F.col(score) < floor).withColumn(
        "causes", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Unknown")))
    )


def failing_in_both(failures: DataFrame, arm: str, a, b, key: str) -> DataFrame:
    one, two = (failures.filter(F.col(arm) == v).select(key) for v in (a, b))
    return one.intersect(two)


# --- parameter sweeps -------------------------------------------------------------------------


def sweep_report(results: DataFrame, params: list[str], metric: str, floor: float = 0.001) -> DataFrame:
    """Mean, std, median and zero count of ``metric`` for every value of every parameter."""
    pairs = F.array(
        *[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("setting")) for p in params]
    )
    long = results.select(F.explode(pairs).alias("p"), metric).select("p.param", "p.setting", metric)
    base = long.groupBy("param", "setting").agg(
        _n().alias("n"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"),
        F.count_if(F.col(metric) < floor).alias("zeros"),
    )
    return with_quantiles(base, long, ["param", "setting"], {"median": (metric, 0.5)})


def sweep_best(results: DataFrame, params: list[str], metric: str) -> DataFrame:
    """Best configuration by mean and the most stable one by std."""
    per = results.groupBy(*params).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    config = F.concat_ws("/", *[F.col(p).cast("string") for p in params])
    return per.select(config.alias("config"), "mean", "std").agg(
        F.max_by("config", F.struct("mean", "config")).alias("best_config"),
        F.max("mean").alias("best_mean"),
        F.min_by("config", F.when(F.col("std").isNotNull(), F.struct("std", "config"))).alias("stable_config"),
        F.min("std").alias("stable_std"),
    )
