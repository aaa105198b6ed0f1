"""Dimension look-ups, nearest sites, as-of joins, containment, and path joins."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.derive import haversine_km, unit_sphere
from ..session import cut_lineage
from .clean import dedupe
from .frames import DAY, micros, rejoin, running, seconds, slice_of, tick_values

# --- equi joins -------------------------------------------------------------------------------


def enrich(
    df: DataFrame, dim: DataFrame, key: str, roles: dict[str, str], how: str = "left"
) -> DataFrame:
    """Attach ``dim`` once per role: ``roles`` maps a fact column to the prefix of the columns it
    brings (origin and destination of one dimension, for example)."""
    for fact_key, prefix in roles.items():
        side = dim.select([F.col(c).alias(f"{prefix}{c}") for c in dim.columns])
        df = df.join(side, F.col(fact_key) == F.col(f"{prefix}{key}"), how).drop(f"{prefix}{key}")
    return df


def coalesce_join(
    df: DataFrame,
    first: DataFrame,
    second: DataFrame,
    on_first: tuple[str, str],
    on_second: tuple[str, str],
    values: list[str],
) -> DataFrame:
    """Two look-ups by alternative keys; the first hit wins per value column."""
    out = df
    for tag, side, (fact, key) in (("a", first, on_first), ("b", second, on_second)):
        renamed = side.select(
            F.col(key).alias(f"_k{tag}"), *[F.col(v).alias(f"_{tag}_{v}") for v in values]
        )
        out = out.join(renamed, F.col(fact) == F.col(f"_k{tag}"), "left").drop(f"_k{tag}")
    picked = [F.coalesce(f"_a_{v}", f"_b_{v}").alias(v) for v in values]
    return out.select(*[c for c in df.columns if c not in values], *picked)


def group_stat_join(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregate on ``keys`` and attach the result to every row."""
    return rejoin(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


def restore_columns(
    base: DataFrame, checkpoints: list[DataFrame], keys: list[str], suffix: str = "_removed"
) -> DataFrame:
    """Bring back columns that ``base`` lost, from earlier checkpoints in order. Keys must be
    unique in every checkpoint."""
    seen = set(base.columns)
    for cp in checkpoints:
        fresh = [c for c in cp.columns if c not in seen]
        if not fresh:
            continue
        if not cp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"keys {keys} are not unique in a checkpoint")
        seen.update(fresh)
        base = rejoin(base, cp.select(*keys, *[F.col(c).alias(c + suffix) for c in fresh]), keys)
    return base


#: Rows of either side that meet in one block of a key's pairs, and pairs of a task.
PAIR_ROWS, TASK_PAIRS = 2000, 4_000_000


def dealt_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """All pairs of rows whose keys agree, dealt evenly over tasks.

    A key's pairs are cut into blocks of about ``PAIR_ROWS`` rows of either side; a row goes to each block of its key that it
    meets rows of the other side in. So few keys with many rows neither gather in few tasks nor wait for one."""

    def counted(df: DataFrame, key: str, n: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(n))

    sizes = counted(left, left_key, "_l").join(counted(right, right_key, "_r"), "_key")
    cuts = sizes.select(
        "_key", *[F.ceil(F.col(c) / PAIR_ROWS).cast("int").alias(c) for c in ("_l", "_r")], (F.col("_l") * F.col("_r")).alias("_n")
    )
    total = cuts.agg(F.sum("_n")).first()[0] or 0
    parts = min(max(math.ceil(total / TASK_PAIRS), 1), 8192)

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        known = df.join(cuts.drop("_n").withColumnRenamed("_key", f"_{key}"), F.col(key) == F.col(f"_{key}"))
        at = F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int")
        copies = known.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return copies.withColumnsRenamed({own: f"{own}{key}", other: f"{other}{key}"}).repartition(parts, f"_{key}", f"_l{key}", f"_r{key}")

    a, b = dealt(left, left_key, "_l", "_r"), dealt(right, right_key, "_r", "_l")
    meet = [F.col(f"{c}{left_key}") == F.col(f"{c}{right_key}") for c in ("_", "_l", "_r")]
    return a.hint("shuffle_hash").join(b, reduce(Column.__and__, meet)).select(*left.columns, *right.columns)


def semi_by_key(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def anti_by_key(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def version_pairs(
    df: DataFrame, version: str, v1, v2, keys: list[str], values: list[str]
) -> DataFrame:
    """Inner join of two result versions on ``keys``, all values non-null on both sides."""

    def side(v, tag: str) -> DataFrame:
        rows = df.filter(F.col(version) == F.lit(v)).dropna(subset=values)
        return rows.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in values])

    return side(v1, "1").join(side(v2, "2"), keys)


def path_aggregate(
    e1: DataFrame, e2: DataFrame, start: str, middle: str, end: str, w1: str, w2: str, name: str
) -> DataFrame:
    """Two-hop sums of weight x coefficient per (start, end). Both edge lists are summed per pair
    first, so parallel edges never multiply."""
    a = e1.groupBy(start, middle).agg(F.sum(w1).alias("_a"))
    b = e2.groupBy(middle, end).agg(F.sum(w2).alias("_b"))
    return a.join(b, middle).groupBy(start, end).agg(F.sum(F.col("_a") * F.col("_b")).alias(name))


def hierarchy_path(hops: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Distinct chains through edge lists ``(frame, from, to)`` where each ``to`` is the next
    ``from``. Each hop is made distinct before it is joined."""
    frames = [f.select(a, b).distinct() for f, a, b in hops]
    out = frames[0]
    for (_, _, prev_to), nxt, (_, a, _) in zip(hops, frames[1:], hops[1:]):
        side = nxt.withColumnRenamed(a, "_from")
        out = out.join(side, F.col(prev_to) == F.col("_from")).drop("_from")
    return out.distinct()


def holiday_window(df: DataFrame, date: str, dates: list[str], k: int, name: str) -> DataFrame:
    """1 where ``date`` lies within ``k`` days of a listed date."""
    listed = df.sparkSession.createDataFrame([(x,) for x in dates], "h string")
    near = listed.select(
        F.explode(
            F.sequence(F.date_sub(F.to_date("h"), k), F.date_add(F.to_date("h"), k))
        ).alias("_day")
    ).distinct()
    flagged = df.join(
        near.withColumn("_hit", F.lit(1)), F.col(date).cast("date") == F.col("_day"), "left"
    )
    return flagged.withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit", "_day")


# --- nearest sites ----------------------------------------------------------------------------

#: Sites in a cell that is searched whole, cuts per axis from one level of cells to the next, and levels.
LEAF_SITES, CUTS, LEVELS = 32, 8, 6


def _cell(xyz: list[Column], level: int) -> Column:
    """Number of the level's cell around a point of the unit cube [-1, 1]^3."""
    n = CUTS**level
    at = [F.greatest(F.least(F.floor((c + 1) / 2 * n), F.lit(n - 1)), F.lit(0)).cast("long") for c in xyz]
    return (at[0] * n + at[1]) * n + at[2]


def _corners(cell: Column, level: int) -> list[tuple[Column, Column]]:
    n = CUTS**level
    at = [F.floor(cell / F.lit(n * n)), F.floor(cell / F.lit(n)) % n, cell % n]
    return [(i * (2.0 / n) - 1, (i + 1) * (2.0 / n) - 1) for i in at]


def _box_distances(a: Column, b: Column, level: int) -> tuple[Column, Column]:
    """Least and largest distance between points of two cells of a level."""
    low, high = F.lit(0.0), F.lit(0.0)
    for (a0, a1), (b0, b1) in zip(_corners(a, level), _corners(b, level)):
        gap = F.greatest(b0 - a1, a0 - b1, F.lit(0.0))
        reach = F.greatest(b1 - a0, a1 - b0)
        low, high = low + gap * gap, high + reach * reach
    return F.sqrt(low), F.sqrt(high)


def nearest_k(
    points: DataFrame, sites: DataFrame, k: int, point_id: str = "point_id", site_id: str = "site_id"
) -> DataFrame:
    """The ``k`` closest sites per point, exact, without comparing every pair.

    Sites are counted in nested cubes around the unit sphere, cut until a cube holds few sites. Cubes that
    hold points are paired with cubes of sites level by level: the smallest reach within which the counts add up to
    ``k`` bounds the search, and pairs that begin beyond it go. Points meet sites only in the last, small cubes, so a dense
    city costs more levels and no larger pairs. Points at one place are searched once, and of sites at
    one place only the first ``k`` count. With fewer sites than ``k`` all of them are returned. Rows without
    a position are left out."""

    def located(df: DataFrame, ident: str) -> DataFrame:
        return df.dropna(subset=["lat", "lon"]).select(
            F.col(ident), *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in ("lat", "lon")]
        )

    asked = located(points, point_id)
    found = _near_pairs(asked, located(sites, site_id), k, site_id)
    km = haversine_km(F.col("plat"), F.col("plon"), F.col("slat"), F.col("slon"))
    compared = found.select("plat", "plon", site_id, km.alias("dist_km"))
    ranked = top_k(compared, ["plat", "plon"], [F.col("dist_km"), F.col(site_id)], k, "rank")
    here = (F.col("lat") == F.col("plat")) & (F.col("lon") == F.col("plon"))
    return asked.join(ranked, here).select(point_id, site_id, "dist_km", "rank")


def _near_pairs(asked: DataFrame, sites: DataFrame, k: int, site_id: str) -> DataFrame:
    """Places of points, each with the sites among which its ``k`` closest are: (plat, plon, site, slat, slon)."""

    def placed(df: DataFrame, tag: str) -> DataFrame:
        xyz = list(unit_sphere(F.col("lat"), F.col("lon")))
        cells = [_cell(xyz, i).alias(f"{tag}{i}") for i in range(LEVELS + 1)]
        return df.select("*", *cells).withColumnsRenamed({"lat": f"{tag}lat", "lon": f"{tag}lon"})

    first = top_k(sites, ["lat", "lon"], [F.col(site_id)], k, "_r").drop("_r")
    s = cut_lineage(placed(first, "s"))
    p = cut_lineage(placed(asked.select("lat", "lon").distinct(), "p"))
    pairs = p.limit(1).select(F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("c"), F.lit(False).alias("leaf"))
    done: list[tuple[int, DataFrame]] = []
    for level in range(1, LEVELS + 1):
        above, here = f"{level - 1}", f"{level}"
        homes = p.select(F.col(f"p{above}").alias("q"), F.col(f"p{here}").alias("q2")).distinct()
        boxes = s.groupBy(F.col(f"s{above}").alias("c"), F.col(f"s{here}").alias("c2")).agg(F.count(F.lit(1)).alias("n"))
        finer = pairs.join(homes, "q").join(boxes, "c")
        low, high = _box_distances(F.col("q2"), F.col("c2"), level)
        seen = F.sum("n").over(W.partitionBy("q2").orderBy("high", "c2").rowsBetween(W.unboundedPreceding, 0))
        reach = F.min(F.when(F.col("seen") >= k, F.col("high"))).over(W.partitionBy("q2"))
        near = (
            finer.select("q2", "c2", "n", low.alias("low"), high.alias("high"))
            .withColumn("seen", seen)
            .withColumn("reach", reach)
            .filter("reach is null or low <= reach + 1e-6")
        )
        small = (F.col("n") <= LEAF_SITES) | F.lit(level == LEVELS)
        # A cube of points goes on while any of its cubes of sites is large.
        whole = F.min(small).over(W.partitionBy("q2"))
        now = cut_lineage(near.select(F.col("q2").alias("q"), F.col("c2").alias("c"), whole.alias("leaf")))
        done.append((level, now.filter("leaf")))
        pairs = now.filter("not leaf")
        if pairs.isEmpty():
            break
    found = []
    for level, ready in done:
        spots = p.select(F.col(f"p{level}").alias("q"), "plat", "plon")
        offers = s.select(F.col(f"s{level}").alias("c"), site_id, "slat", "slon")
        found.append(ready.join(spots, "q").join(offers, "c").select("plat", "plon", site_id, "slat", "slon"))
    return reduce(DataFrame.unionByName, found)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """First ``k`` rows per key with their rank; the rank limit also runs before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


# --- as-of joins ------------------------------------------------------------------------------


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    ts: str,
    tolerance: int | None = None,
    direction: str = "backward",
    right_ts: str | None = None,
    prefix: str = "r_",
    plan: str = "merge",
    bucket: int = DAY,
    allow_exact: bool = True,
) -> DataFrame:
    """Attach to every left row the last right row at or before its time (``backward``) or the
    first at or after it (``forward``), within ``tolerance`` seconds, with the lag in minutes.

    ``merge`` interleaves both sides and carries the last right row forward, bucket by bucket, so
    neither dense right sides nor hot keys gather in one task. ``range`` cuts time into slices as
    wide as the tolerance and compares slice neighbours; it suits sparse right sides. Ties on the
    right are settled by the largest right row. ``allow_exact=False`` asks for strictly earlier.
    A null key or time matches nothing on either side.
    """
    right_ts = right_ts or ts
    sign = 1 if direction == "backward" else -1
    payload = [c for c in right.columns if c not in by]
    row = F.struct(*[F.col(c) for c in sorted(payload, key=lambda c: c != right_ts)])
    r = right.select(*by, (micros(right_ts) * sign).alias("_t"), row.alias("_row")).dropna(subset=[*by, "_t"])
    limit = None if tolerance is None else tolerance * 1000000
    if plan == "merge":
        tagged = left.withColumn("_t", micros(ts) * sign).dropna(subset=[*by, "_t"])
        l_row = F.struct(*[F.col(c) for c in left.columns if c not in by])
        side_l, side_r = (1, 0) if allow_exact else (0, 1)
        both = tagged.select(
            *by, "_t", F.lit(side_l).alias("_side"), l_row.alias("_left"),
            F.lit(None).cast(r.schema["_row"].dataType).alias("_row"),
        ).unionByName(
            r.select(
                *by, "_t", F.lit(side_r).alias("_side"),
                F.lit(None).cast(tagged.select(l_row.alias("x")).schema["x"].dataType).alias("_left"),
                "_row",
            )
        )
        seen = F.when(F.col("_row").isNotNull(), F.struct("_t", "_row"))
        carried = running(
            both, by, slice_of(F.col("_t"), bucket * 1000000),
            [F.col("_t"), F.col("_side"), F.col("_row")], {"_hit": ("last", seen)},
        ).filter(F.col("_left").isNotNull())
        hit = F.col("_hit")
        if limit is not None:
            hit = F.when(F.col("_t") - hit["_t"] <= limit, hit)
        rows = carried.select(*by, "_left.*", (F.col("_t") - hit["_t"]).alias("_lag"), hit["_row"].alias("_m"))
        absent = reduce(Column.__or__, [F.col(c).isNull() for c in [*by, ts]])
        alone = left.filter(absent).select(  # these go round the windows
            *by, *[c for c in left.columns if c not in by], F.lit(None).cast("long").alias("_lag"),
            F.lit(None).cast(r.schema["_row"].dataType).alias("_m"),
        )
        rows = rows.unionByName(alone)
    elif plan == "range":
        if limit is None:
            raise ValueError("the range plan needs a tolerance")
        numbered = left.withColumn("_t", micros(ts) * sign).withColumn(
            "_id", F.struct(*[F.col(c) for c in left.columns])
        )
        home = slice_of(F.col("_t"), limit)
        probe = numbered.select(*by, "_t", home.alias("_s")).distinct()
        spread = r.withColumn("_s", F.explode(F.array(home, home + 1))).withColumnRenamed("_t", "_rt")
        gap = F.col("_t") - F.col("_rt")
        near = (gap >= 0 if allow_exact else gap > 0) & (gap <= limit)
        best = (
            probe.join(spread, [*by, "_s"])
            .filter(near)
            .groupBy(*by, "_t")
            .agg(F.max(F.struct("_rt", "_row")).alias("_best"))
        )
        rows = rejoin(numbered.drop("_id"), best, [*by, "_t"]).select(
            *left.columns, (F.col("_t") - F.col("_best._rt")).alias("_lag"), F.col("_best._row").alias("_m")
        )
    else:
        raise ValueError(f"unknown plan {plan}")
    return rows.select(
        *left.columns,
        *[F.col("_m")[c].alias(f"{prefix}{c}") for c in payload],
        F.floor(F.col("_lag") / 60000000).cast("long").alias("lag_minutes"),
    )


def asof_join_ranked(
    left: DataFrame,
    candidates: DataFrame,
    right: DataFrame,
    row_id: str,
    place: str,
    site: str,
    ts: str,
    tolerance: int,
    right_ts: str | None = None,
    prefix: str = "r_",
    fallback: bool = True,
    plan: str = "merge",
) -> DataFrame:
    """As-of join over several candidate sites per place (``candidates``: place, site, rank).

    The best-ranked site that has an observation inside the tolerance wins; rows without any keep
    nulls. With ``fallback=False`` the first-ranked site is kept even when it has nothing to offer.
    """
    probes = left.join(candidates, place, "left")
    joined = asof_join(probes, right, [site], ts, tolerance, right_ts=right_ts, prefix=prefix, plan=plan)
    order = [F.col("rank").asc_nulls_last()]
    if fallback:
        order.insert(0, F.col("lag_minutes").isNull().cast("int"))
    return dedupe(joined, [row_id], order)


def incoming_activity(
    df: DataFrame, origin: str, dest: str, ts: str, span: int, name: str
) -> DataFrame:
    """Rows heading for X within the trailing ``span`` seconds, attached to rows leaving X at the
    same instant; 0 where nothing matches."""
    moments = df.select(dest, ts).withColumn("_tick", seconds(ts))
    framed = tick_values(moments, [dest], -span, 0, {name: ("count", F.lit(1))})
    arrivals = rejoin(moments.distinct(), framed, [dest, "_tick"])
    side = arrivals.select(F.col(dest).alias("_d"), F.col(ts).alias("_at"), name)
    joined = df.join(side, (F.col(origin) == F.col("_d")) & (F.col(ts) == F.col("_at")), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0))).drop("_d", "_at")


# --- containment ------------------------------------------------------------------------------

#: Gram lengths and the grams of a window; a text takes the longest of which it holds a whole window.
_GRAMS = {1: 1, 2: 1, 4: 2, 8: 4, 16: 8}


#: Characters of texts up to which what comes of them may be broadcast.
SENT_CHARS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _minima(text: str, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each of the gram lengths the distinct smallest gram hashes of all windows of grams."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out: dict[int, np.ndarray] = {}
    h = _mixed(codes + np.uint64(1))
    for q, window in _GRAMS.items():
        if q > 1:  # two halves make a gram of twice the length
            half = q // 2
            if len(h) <= half:
                break
            h = _mixed(h[:-half] * np.uint64(0xD1342543DE82EF95) + h[half:])
        if q in lengths and len(h) >= window:
            low, have = h, 1
            while have < window:
                low, have = np.minimum(low[:-have], low[have:]), have * 2
            out[q] = np.unique(low).view(np.int64)
    return out


def _gram_length(text: Column) -> Column:
    return F.greatest(*[F.when(F.length(text) >= q + w - 1, F.lit(q)).otherwise(0) for q, w in _GRAMS.items()])


def contains_join(
    a: DataFrame, b: DataFrame, a_id: str, a_text: str, b_id: str, b_text: str
) -> DataFrame:
    """Pairs where one text contains the other, ignoring case: ``(a_id, b_id)``.

    A text takes part with grams of 1 to 16 characters, the longer the text the longer the gram. Of each window of
    grams the smallest hash is kept, so a text held by another keeps hashes that the other one keeps too. Of these
    the one that the fewest other texts keep becomes its only key; texts that meet on it are compared. Equal texts
    are compared once. Empty and null texts match nothing."""

    def side(df: DataFrame, ident: str, text: str) -> tuple[DataFrame, DataFrame]:
        named = df.select(F.col(ident).alias("id"), F.lower(text).alias("t")).filter(F.length("t") > 0)
        keyed = cut_lineage(named.select("id", F.unhex(F.md5("t")).alias("h"), "t"))
        return keyed.select("id", "h").distinct(), keyed.select("h", "t").dropDuplicates(["h"])

    x_ids, x = side(a, a_id, a_text)
    y_ids, y = side(b, b_id, b_text)
    n_x, n_y = _chars(a.select(F.col(a_text).alias("t"))), _chars(b.select(F.col(b_text).alias("t")))
    one = _holding(x, y, meetings(x, y, n_y), n_x, n_y).select(F.col("big").alias("hx"), F.col("small").alias("hy"))
    two = _holding(y, x, meetings(y, x, n_x), n_y, n_x).select(F.col("small").alias("hx"), F.col("big").alias("hy"))
    pairs = one.unionByName(two).distinct()
    left = x_ids.select(F.col("h").alias("hx"), F.col("id").alias(a_id))
    right = y_ids.select(F.col("h").alias("hy"), F.col("id").alias(b_id))
    return pairs.join(left, "hx").join(right, "hy").select(a_id, b_id).distinct()


def _chars(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0


def _unsent(df: DataFrame, chars: int) -> DataFrame:
    """What comes of many texts is never broadcast: its estimated size is that of the packed file, or of a few columns,
    while grams by the million would be gathered in the driver."""
    return df.hint("merge") if chars > SENT_CHARS else df


def meetings(big: DataFrame, small: DataFrame, small_chars: int | None = None) -> DataFrame:
    """``(big, small)`` of texts that share the small one's rarest gram; both sides are distinct ``(h, t)``."""
    small_chars = _chars(small) if small_chars is None else small_chars
    length = _gram_length(F.col("t"))
    lengths = sorted(r[0] for r in small.select(length).distinct().collect())  # at most five numbers

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def every(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.concatenate([*_minima(t, lengths).values(), np.empty(0, np.int64)]))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def own(texts: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([_minima(t, [n])[n] for t, n in zip(texts, q)], dtype=object)

    wanted = small.select(F.col("h").alias("small"), F.explode(own("t", length)).alias("g"))
    held = big.select(F.col("h").alias("big"), F.explode(every("t")).alias("g"))
    held = cut_lineage(held.join(_unsent(wanted.select("g").distinct(), small_chars), "g", "left_semi"))
    spread = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    seen = wanted.join(spread, "g", "left")  # a gram that no text holds rules its own text out
    rarest = seen.groupBy("small").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("k"))
    keys = rarest.filter("k.n > 0").select("small", F.col("k.g").alias("g"))
    return held.join(_unsent(keys, small_chars), "g").select("big", "small")


def _holding(
    big: DataFrame, small: DataFrame, meet: DataFrame, big_chars: int | None = None, small_chars: int | None = None
) -> DataFrame:
    big_chars, small_chars = (_chars(df) if n is None else n for df, n in ((big, big_chars), (small, small_chars)))
    held = _unsent(big.select(F.col("h").alias("big"), F.col("t").alias("tb")), big_chars)
    texts = meet.join(held, "big").join(
        _unsent(small.select(F.col("h").alias("small"), F.col("t").alias("ts")), small_chars), "small"
    )
    return texts.filter(F.contains("tb", "ts")).select("big", "small")
