"""Product codes of vectors; exact Lloyd rounds that skip entries by norm-of-sum bounds.

Every part of a vector keeps, for each group of codebook entries, a lower bound on its distance to the group's
entries other than its own, and the round in which that bound was taken (its stamp). The codebooks of all rounds
are kept, so in a later round the bound falls by the net displacement of the group's entries since the stamp,
the norm of the sum of their moves, which is at most the sum of the norms of the moves and less wherever an entry
wanders back and forth. A group is scanned again only if its lowered bound does not exceed the distance to the own
entry; bounds are rounded down and displacements up, so a skipped group holds no entry as near, not even a tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.frames import rejoin
from plumbline.session import cut_lineage, release

#: Entries whose bound is kept together.
GROUP = 32
#: Components stay exact below this size; a larger one is an error.
LIMIT = 1 << 28
#: Rows a task works on at once.
ROWS = 4096


class Codes(NamedTuple):
    """``rows``: id, label, codes (an entry per part) and error; ``books``: part x entry x component;
    ``scanned``: share of the group scans that a plain search would make, by round."""

    rows: DataFrame
    books: np.ndarray
    scanned: list[float]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, comma-joined."""
        return sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x entries, as integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:  # every number on the way fits a double
        x, book = x.astype(np.float64), book.astype(np.float64)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    return d.astype(np.int64)


def displacements(history: np.ndarray) -> np.ndarray:
    """``[stamp, part, group]``: how far an entry of the group lies at most from where it was in round ``stamp``,
    rounded up. ``history`` is round x part x entry x component, the last round being the present."""
    gap = (history[-1][None] - history).astype(np.float64)
    far = np.ceil(np.sqrt((gap * gap).sum(axis=3))) + 1
    far[(gap == 0).all(axis=3)] = 0
    groups = -(-far.shape[2] // GROUP)
    full = np.zeros((*far.shape[:2], groups * GROUP))
    full[:, :, : far.shape[2]] = far
    return full.reshape(*far.shape[:2], groups, GROUP).max(axis=3).astype(np.int64)


def assign(
    x: np.ndarray, book: np.ndarray, moved: np.ndarray, now: int, own: np.ndarray, bounds: np.ndarray, stamps: np.ndarray
) -> tuple[np.ndarray, int]:
    """Nearest entry of one part for each row, ties to the lower index; returns the squared distances and the
    number of scans. ``own``, ``bounds`` and ``stamps`` (rows x groups) are brought up to date in place;
    ``moved[stamp, group]`` as from ``displacements``. Stamp -1 asks for a first scan."""
    n, groups = bounds.shape
    gap = x - book[own]
    best = (gap * gap).sum(axis=1)
    start = own.copy()
    scans = 0

    def scan(g: int, rows: np.ndarray) -> None:
        nonlocal scans
        scans += len(rows)
        entries = book[g * GROUP : (g + 1) * GROUP]
        d = _squares(x[rows], entries)
        order = np.arange(len(rows))
        near = d.argmin(axis=1)
        first = d[order, near]
        d[order, near] = np.iinfo(np.int64).max
        low[rows, g], low_at[rows, g] = first, near + g * GROUP
        second[rows, g] = d.min(axis=1)
        fresh[rows, g] = True
        closer = (first < best[rows]) | ((first == best[rows]) & (low_at[rows, g] < own[rows]))
        own[rows[closer]], best[rows[closer]] = low_at[rows[closer], g], first[closer]

    low = np.zeros((n, groups), dtype=np.int64)
    second, low_at = np.zeros_like(low), np.zeros_like(low)
    fresh = np.zeros((n, groups), dtype=bool)
    for g in range(groups):
        shift = moved[np.maximum(stamps[:, g], 0), g]
        reach = bounds[:, g] - shift
        kept = (stamps[:, g] >= 0) & (reach > 0) & (reach * reach > best)
        scan(g, np.flatnonzero(~kept))
    home = start // GROUP
    left = (own != start) & ~fresh[np.arange(n), home]  # a bound that left out the old own entry
    for g in np.unique(home[left]):
        scan(int(g), np.flatnonzero(left & (home == g)))
    others = np.where(low_at == own[:, None], second, low)
    floor = np.where(others == np.iinfo(np.int64).max, 1 << 30, np.sqrt(others.astype(np.float64)).astype(np.int64) - 1)
    bounds[fresh] = floor[fresh]
    stamps[fresh] = now
    return best, scans


def _lists(x: np.ndarray, kind) -> pa.Array:
    flat = pa.array(x.ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _round(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """One assignment pass over ``(id, label, x, own, bounds, stamps, error, scans)``."""
    now, parts, entries, width = len(history) - 1, *history.shape[1:]
    book, moved = history[-1], displacements(history)
    groups, names = moved.shape[2], rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                x = _matrix(batch["x"], parts * width).reshape(n, parts, width).astype(np.int64)
                own = _matrix(batch["own"], parts).astype(np.int64)
                bounds = _matrix(batch["bounds"], parts * groups).reshape(n, parts, groups).astype(np.int64)
                stamps = _matrix(batch["stamps"], parts * groups).reshape(n, parts, groups).astype(np.int64)
                error, scans = np.zeros(n, dtype=np.int64), 0
                for p in range(parts):
                    mine, b, s = own[:, p].copy(), bounds[:, p].copy(), stamps[:, p].copy()
                    best, seen = assign(x[:, p], book[p], moved[:, p], now, mine, b, s)
                    own[:, p], bounds[:, p], stamps[:, p] = mine, b, s
                    error += best
                    scans += seen
                share = np.zeros(n, dtype=np.int64)
                share[0] = scans  # summed over all rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"], batch["label"], batch["x"], _lists(own, pa.int32()),
                        _lists(bounds.reshape(n, -1), pa.int32()), _lists(stamps.reshape(n, -1), pa.int32()),
                        pa.array(error), pa.array(share),
                    ],
                    names,
                )

    return cut_lineage(rows.mapInArrow(work, rows.schema))


def _moved_book(rows: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of its parts' mean; sums are combined before the shuffle, and at most
    parts x entries rows come back."""
    parts, entries, width = book.shape
    each = F.explode(
        F.array(*[F.struct(F.lit(p).alias("p"), F.col("own")[p].alias("e"), F.slice("x", p * width + 1, width).alias("v")) for p in range(parts)])
    )
    long = rows.select(each.alias("m")).select("m.*")
    sums = long.groupBy("p", "e").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)])
    after = book.copy()
    for r in sums.collect():
        after[r["p"], r["e"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return after


def _usable(df: DataFrame, vector: str, scale: int) -> Column:
    """The scaled components as integers, null where the vector is null or holds null or non-finite ones."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    big = F.raise_error(F.lit(f"a component times {scale} lies beyond {LIMIT}"))

    def whole(v: Column) -> Column:
        y = F.floor(v.cast("double") * scale)
        return F.when(F.abs(v.cast("double") * scale) < LIMIT, y).otherwise(big).cast("int")

    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, whole))


def product_codes(
    df: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> Codes:
    """Code every vector by the nearest codebook entry of each of its ``parts``, after ``rounds`` rounds of exact
    nearest assignment and floored means. Components are ``floor(scale * x)``.

    The codebooks start as the ``entries`` smallest ids' vectors (ties between equal ids by the vector, ids that are null
    last; fewer rows give fewer entries). Vectors that are null or hold null or non-finite components take no part, nor do
    those of another length than the first entry's, which must divide by ``parts``. Repeated rows are coded each. Of
    ``df`` only the three named columns are read, so other columns clash with nothing; an empty table gives no rows and
    empty codebooks. Driver and broadcast hold codebooks alone: (rounds + 1) x parts x entries vectors' parts."""
    vectors = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    base = cut_lineage(vectors.select("id", "label", _usable(vectors, "v", scale).alias("x")).where("x is not null"))
    order = [F.col("id").asc_nulls_last(), F.col("x")]
    lowest = base.select("id").orderBy(order[0]).limit(entries).agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"), F.count("id").alias("m")).first()
    few = base if lowest["m"] < lowest["n"] or lowest["n"] < entries else base.where(F.col("id") <= F.lit(lowest["top"]))
    first = [r["x"] for r in few.select("id", "x").orderBy(*order).limit(entries).collect()]
    size = len(first[0]) if first else 0
    if size % parts or (first and not size):
        raise ValueError(f"{size} components do not divide into {parts} parts")
    first = [x for x in first if len(x) == size]
    book = np.array(first, dtype=np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
    groups = -(-len(first) // GROUP)
    blank = lambda n, v: F.array_repeat(F.lit(v).cast("int"), n)
    rows = base.where(F.size("x") == size).select(
        "id", "label", "x", blank(parts, 0).alias("own"), blank(parts * groups, 0).alias("bounds"),
        blank(parts * groups, -1).alias("stamps"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scans"),
    )
    history, scanned, before = [book], [], base
    if not first:
        return Codes(rows.select("id", "label", F.col("own").alias("codes"), "error"), book, scanned)
    for r in range(rounds + 1):
        after = _round(rows, np.array(history))
        release(before)
        rows = before = after
        total = rows.agg(F.sum("scans").alias("s"), F.count(F.lit(1)).alias("n")).first()
        scanned.append(total["s"] / (total["n"] * parts * groups))
        if r < rounds:
            history.append(_moved_book(rows, history[-1]))
    return Codes(rows.select("id", "label", F.col("own").alias("codes"), "error"), history[-1], scanned)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Codes with ``label_error``, the error summed over equal labels (nulls together); the sums are made
    before any row is shuffled by its label."""
    return rejoin(rows, rows.groupBy("label").agg(F.sum("error").alias("label_error")), ["label"])
