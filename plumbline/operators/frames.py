"""Window frames that stay bounded when one key owns a large share of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. The three frames below give
the same answers from partitions bounded by time or by row count:

``tick_frame``    range frames over a tick (second, day): rows are first combined per (key, tick),
                  then each key is cut into slices as wide as the frame, with one slice of halo.
``running``       unbounded prefixes: a local prefix inside (key, bucket) plus the prefix of the
                  bucket totals. Buckets are counted first; ``bounded_buckets`` cuts crowded ones.
``row_frame``     fixed-length row frames: rows are numbered per key through bucket offsets, cut
                  into chunks, and the last rows of a chunk are copied to the next one as halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import cut_lineage

DAY = 86400
#: Rows of one (key, bucket) beyond which the bucket is cut further.
BUCKET_ROWS = 1_000_000
#: Table of crowded buckets that is still broadcast.
BROADCAST_ROWS = 10_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; a timestamp without zone counts on its own clock, whatever the session's zone."""
    c = col(ts)
    plain = c.cast("timestamp_ntz")
    clock = F.hour(plain) * 3600 + F.minute(plain) * 60
    part = (F.date_part(F.lit("SECOND"), plain) * 1000000).cast("long")
    own = (F.unix_date(plain.cast("date")).cast("long") * DAY + clock) * 1000000 + part
    return F.when(F.typeof(c) == "timestamp_ntz", own).otherwise(F.unix_micros(c.cast("timestamp")))


def seconds(ts: str | Column) -> Column:
    return F.floor(micros(ts) / F.lit(1000000)).cast("long")


def days(ts: str | Column) -> Column:
    return F.unix_date(col(ts).cast("date")).cast("long")


def slice_of(tick: Column, width: int) -> Column:
    return F.floor(tick / F.lit(width)).cast("long")


# Moments kept per (key, tick) for each kind of aggregate, and how a frame combines them.
_PARTS = {
    "count": ("n",),
    "sum": ("s",),
    "avg": ("n", "s"),
    "std": ("n", "s", "v"),
    "min": ("lo",),
    "max": ("hi",),
}


def _part(kind: str, x: Column) -> Column:
    return {
        "n": F.count(x),
        "s": F.sum(x),
        "v": F.var_pop(x) * F.count(x),
        "lo": F.min(x),
        "hi": F.max(x),
    }[kind]


def _over(kind: str, part: Column, w) -> Column:
    fold = {"n": F.sum, "s": F.sum, "v": F.sum, "lo": F.min, "hi": F.max}[kind]
    return fold(part).over(w)


def tick_frame(
    df: DataFrame,
    keys: list[str],
    tick: Column,
    lo: int,
    hi: int,
    aggs: dict[str, tuple[str, str | Column]],
    min_slice: int = 1,
) -> DataFrame:
    """Add aggregates over ``[tick+lo, tick+hi]`` within ``keys``.

    ``aggs`` maps an output name to ``(kind, column)`` with kind count, sum, avg, std, min or max.
    Counts are 0 and everything else null on an empty frame. Rows are combined per (key, tick)
    before the first shuffle, so no window partition grows with the rows of a hot key.
    """
    base = df.withColumn("_tick", tick)
    framed = tick_values(base, keys, lo, hi, aggs, min_slice)
    return rejoin(base, framed, [*keys, "_tick"]).drop("_tick")


def tick_values(
    base: DataFrame, keys: list[str], lo: int, hi: int, aggs: dict[str, tuple[str, str | Column]], min_slice: int = 1
) -> DataFrame:
    """The frame of ``tick_frame`` once per ``(*keys, _tick)`` of ``base``."""
    parts: dict[tuple[str, str], str] = {}
    exprs = []
    for name, (kind, source) in aggs.items():
        for p in _PARTS[kind]:
            slot = f"_{p}_{name}"
            parts[(name, p)] = slot
            exprs.append(_part(p, col(source)).alias(slot))
    per_tick = base.groupBy(*keys, "_tick").agg(*exprs)

    width = max(abs(lo), abs(hi), min_slice, 1)
    home = slice_of(F.col("_tick"), width)
    copies = [F.struct(home.alias("slice"), F.lit(True).alias("own"))]
    if lo < 0:
        copies.append(F.struct((home + 1).alias("slice"), F.lit(False).alias("own")))
    if hi > 0:
        copies.append(F.struct((home - 1).alias("slice"), F.lit(False).alias("own")))
    sliced = per_tick.withColumn("_c", F.explode(F.array(*copies)))
    w = (
        W.partitionBy(*keys, F.col("_c.slice")).orderBy("_tick").rangeBetween(lo, hi)
    )
    outs = []
    centred = {}
    for name, (kind, _) in aggs.items():
        if kind == "std":  # deviations from the slice's mean, so large values do not cancel
            n, s = (F.col(parts[(name, p)]) for p in ("n", "s"))
            whole = W.partitionBy(*keys, F.col("_c.slice"))
            centred[f"_d_{name}"] = s / F.nullif(n, F.lit(0)) - F.sum(s).over(whole) / F.nullif(F.sum(n).over(whole), F.lit(0))
    sliced = sliced.withColumns(centred) if centred else sliced
    for name, (kind, _) in aggs.items():
        v = {p: _over(p, F.col(parts[(name, p)]), w) for p in _PARTS[kind]}
        if kind == "count":
            out = F.coalesce(v["n"], F.lit(0)).cast("long")
        elif kind == "avg":
            out = v["s"] / F.nullif(v["n"], F.lit(0))
        elif kind == "std":
            n, d = F.col(parts[(name, "n")]), F.col(f"_d_{name}")
            off, square = F.sum(n * d).over(w), F.sum(n * d * d).over(w)
            spread = F.greatest(v["v"] + square - off * off / F.nullif(v["n"], F.lit(0)), F.lit(0.0))
            out = F.when(v["n"] > 1, F.sqrt(spread / F.nullif(v["n"] - 1, F.lit(0))))
        else:
            out = next(iter(v.values()))
        outs.append(out.alias(name))
    return (
        sliced.select(*keys, "_tick", F.col("_c.own").alias("_own"), *outs)
        .filter("_own")
        .drop("_own")
    )


def rejoin(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join (left by default) on null-safe keys, keeping the left key columns. The strategy is left to the
    optimizer, which broadcasts only below its size limit and splits skewed partitions. Without
    keys ``stats`` is a single row, read once as a scalar subquery."""
    if not keys:
        row = stats.select(F.struct("*").alias("_row")).scalar()
        return df.withColumn("_row", row).select("*", "_row.*").drop("_row")
    cond = None
    right = stats
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return df.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def inside(t: Column, lo: Column, hi: Column, n: Column, limit: int) -> Column:
    """Which of ``4 n / limit`` equal parts of ``[lo, hi]`` holds ``t``, without overflow and never falling with ``t``;
    nulls and infinities get parts of their own before and after, NaN the last one."""
    parts = F.greatest(F.ceil(n * 4 / F.lit(limit)), F.lit(64)).cast("double")
    halves = (t.cast("double") / 2 - lo.cast("double") / 2) / (hi.cast("double") / 2 - lo.cast("double") / 2)
    whole = F.try_subtract(t, lo).cast("double") / F.try_subtract(hi, lo).cast("double")
    share = F.when((F.typeof(t) == "bigint") & F.try_subtract(hi, lo).isNotNull(), whole).otherwise(halves)
    place = F.least(F.floor(share * parts), parts - 1)
    return F.when(odd(t) < 0, odd(t)).when(odd(t) > 0, parts - 1 + odd(t)).otherwise(place).cast("long")


def odd(t: Column) -> Column:
    """-2 for null, -1 and 1 for the infinities, 2 for NaN, 0 for what has a place between."""
    d, low = t.cast("double"), F.lit(float("-inf"))
    return F.when(d.isNull(), -2).when(d == low, -1).when(F.isnan(d), 2).when(d == -low, 1).otherwise(0)


def finite(t: Column) -> Column:
    return F.when(odd(t) == 0, t)


def _tick_columns(df: DataFrame, order: list[Column]) -> list[Column]:
    """The leading order columns that are numbers or instants, as numbers."""
    named = df.select(*[c.alias(f"o{i}") for i, c in enumerate(order)]).schema
    out = []
    for c, f in zip(order, named):
        if isinstance(f.dataType, T.IntegralType):
            out.append(c.cast("long"))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(c.cast("double"))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.unix_date(c).cast("long"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(micros(c))
        else:
            break
    return out


def bounded_buckets(df: DataFrame, keys: list[str], order: list[Column], name: str, limit: int | None = None) -> DataFrame:
    """Cut every ``(*keys, name)`` of more than ``limit`` rows along ``order``, until none is larger or its rows tie.

    One count per bucket decides, and where none is crowded the frame comes back as it is. A crowded bucket is cut
    into equal parts of its own range of the first order column, about four times as many as limits fit in; parts that
    are still crowded are cut again, and where all rows agree the next order column goes on. ``name`` stays in
    order: it becomes a struct of the bucket and the part. The table of crowded buckets has at most one row per ``limit``
    rows of ``df``; it is broadcast while its counted size is small and joined otherwise."""
    limit = limit or BUCKET_ROWS
    most = df.groupBy(*keys, name).count().agg(F.max("count")).first()[0]
    if (most or 0) <= limit:
        return df
    for tick in _tick_columns(df, order):
        while True:
            at = df.select(*keys, name, tick.alias("_t"))
            t = F.col("_t")
            spans = at.groupBy(*keys, name).agg(
                F.count(F.lit(1)).alias("_n"), F.min(finite(t)).alias("_lo"), F.max(finite(t)).alias("_hi"),
                F.min(odd(t)).alias("_first"), F.max(odd(t)).alias("_last"),
            )
            can_split = (F.col("_lo") < F.col("_hi")) | (F.col("_first") < F.col("_last"))
            crowded = cut_lineage(spans.filter((F.col("_n") > limit) & can_split).drop("_first", "_last"))
            n = crowded.count()
            if not n:
                break
            side = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
            part = inside(tick, F.col("_lo"), F.col("_hi"), F.col("_n"), limit)
            cut = F.struct(F.col(name).alias("b"), F.when(F.col("_n").isNotNull(), part).alias("p"))
            df = rejoin(df, side, [*keys, name]).withColumn(name, cut).drop("_n", "_lo", "_hi")
    return df


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    specs: dict[str, tuple[str, str | Column]],
    include_current: bool = True,
) -> DataFrame:
    """Prefix aggregates within ``keys`` in ``order``; ``bucket`` must not decrease along it.

    ``specs`` maps a name to ``(kind, column)``: count, sum, min, max or last (last non-null).
    Work is split into (key, bucket) partitions, crowded buckets being cut by count, and only bucket
    totals are scanned per key. ``order`` holds plain ascending columns.
    """
    b = bounded_buckets(df.withColumn("_b", bucket), keys, order, "_b")
    local_w = (
        W.partitionBy(*keys, "_b")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    )
    prefix_w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    folds = {
        "count": (F.count, F.sum),
        "sum": (F.sum, F.sum),
        "min": (F.min, F.min),
        "max": (F.max, F.max),
    }
    locals_, totals, prefixes, outs = [], [], [], []
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    for name, (kind, source) in specs.items():
        x, l, t, p = col(source), f"_l_{name}", f"_t_{name}", f"_p_{name}"
        if kind == "last":
            locals_.append(F.last(x, ignorenulls=True).over(local_w).alias(l))
            totals.append(F.max_by(x, F.when(x.isNotNull(), rank)).alias(t))
            prefixes.append(F.last(F.col(t), ignorenulls=True).over(prefix_w).alias(p))
            outs.append(F.coalesce(F.col(l), F.col(p)).alias(name))
            continue
        first, again = folds[kind]
        locals_.append(first(x).over(local_w).alias(l))
        totals.append(first(x).alias(t))
        prefixes.append(again(F.col(t)).over(prefix_w).alias(p))
        if kind == "count":
            outs.append((F.coalesce(F.col(l), F.lit(0)) + F.coalesce(F.col(p), F.lit(0))).alias(name))
        elif kind == "sum":
            both = F.coalesce(F.col(l), F.lit(0)) + F.coalesce(F.col(p), F.lit(0))
            outs.append(F.when(F.col(l).isNotNull() | F.col(p).isNotNull(), both).alias(name))
        else:
            pick = F.least if kind == "min" else F.greatest
            outs.append(pick(F.col(l), F.col(p)).alias(name))
    rows = b.select("*", *locals_)
    heads = b.groupBy(*keys, "_b").agg(*totals).select(*keys, "_b", *prefixes)
    return rejoin(rows, heads, [*keys, "_b"]).select(*df.columns, *outs)


def number_rows(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """1-based row number within ``keys`` in ``order``, from bucket offsets."""
    return running(df, keys, bucket, order, {name: ("count", F.lit(1))})


def row_frame(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    before: int,
    after: int,
    exprs,
    chunk: int = 50000,
) -> DataFrame:
    """Evaluate window expressions that look at most ``before`` rows back and ``after`` rows on.

    ``exprs(window)`` gets an ordered window and returns ``{name: Column}``; frames inside it may
    use ``window.rowsBetween(-before, after)``, ``lag`` and ``lead`` up to those distances.
    """
    size = max(chunk, before, after)
    numbered = number_rows(df, keys, bucket, order, "_row")
    pos = F.col("_row") - 1
    home = slice_of(pos, size)
    at = pos % F.lit(size)
    copies = [F.struct(home.alias("chunk"), F.lit(True).alias("own"))]
    if before:
        copies.append(
            F.when(at >= size - before, F.struct((home + 1).alias("chunk"), F.lit(False).alias("own")))
        )
    if after:
        copies.append(
            F.when(at < after, F.struct((home - 1).alias("chunk"), F.lit(False).alias("own")))
        )
    spread = numbered.withColumn("_c", F.explode(F.array_compact(F.array(*copies))))
    w = W.partitionBy(*keys, F.col("_c.chunk")).orderBy("_row")
    named = exprs(w)
    kept = [c for c in df.columns if c not in named]
    return (
        spread.select(*kept, *[c.alias(n) for n, c in named.items()], F.col("_c.own").alias("_own"))
        .filter("_own")
        .drop("_own")
    )


def per_group(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates joined back onto the rows: the two-phase form of an unordered window."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return rejoin(df, stats, keys)


# --- arrays inside a row ----------------------------------------------------------------------


def once(df: DataFrame, **new: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later expressions (lambdas included) use them."""
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))).alias("_once")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in new]
    return df.select(*kept, held).select(*kept, "_once.*")


def prefixes(df: DataFrame, items: str, name: str, value, fold, zero: Column) -> DataFrame:
    """Add ``name[i]``, the fold of ``value`` over the first ``i`` elements of an array, for i = 0 to its size.

    Two levels of blocks keep the work at size x its square root, without a growing array being copied."""
    n, w = F.size(items), F.col("_width")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: fold(a, value(x)))

    out = once(df, _width=F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int"))
    out = once(out, _blocks=F.transform(F.sequence(F.lit(0), F.floor(n / w).cast("int")), lambda b: total(F.slice(items, b * w + 1, w))))
    before = F.transform(
        F.sequence(F.lit(0), F.size("_blocks") - 1), lambda i: F.aggregate(F.slice("_blocks", F.lit(1), i), zero, fold)
    )
    out = once(out, _before=before)

    def at(i: Column) -> Column:
        b = F.floor(i / w).cast("int")
        return fold(F.get("_before", b), total(F.slice(items, b * w + 1, i % w)))

    out = once(out, **{name: F.transform(F.sequence(F.lit(0), n), at)})
    return out.drop("_width", "_blocks", "_before")
