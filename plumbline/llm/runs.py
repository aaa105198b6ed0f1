"""Periodic runs of words by multi-scale minimizers.

A run of smallest period ``p`` repeats its word grams at distance ``p``. For each scale ``w`` (periods
from ``w`` to ``2w - 1``) every window of ``w`` neighbouring grams, each ``2w`` words long, picks its
smallest gram; inside a run the same gram is picked again one period later. Pairs of equal picked grams at
a distance of that scale are the seeds, which are extended word by word to the whole run. Grams that repeat
a period of at most ``w / 2`` within themselves lie in runs found before and are not picked. That depends on
their words alone, so no run loses its seeds, and equal grams left over lie more than ``w / 2`` apart, so
the pairs grow with the text and not with the square of a repeated word. Periods below ``DIRECT`` are found by
comparing the words with themselves, shifted.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Periods below this one are scanned directly; the first scale starts here.
DIRECT = 8
#: A run holds its period at least this often, and at least this many words.
TIMES, WORDS = 4, 6
#: Text that a task works on at once; a longer text is taken alone.
BATCH_BYTES = 4 << 20

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(_RUN)),
    T.StructField("collapsed", T.StringType()),
]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(fold, x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = fold(x[:-step], x[step:])
        have += step
    return x


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring words that depends on these words alone."""
    n = len(words)
    powers = np.full(n + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mixed(words.astype(np.uint64)) * powers[:-1], out=sums[1:])
    back = np.full(n - size + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    return _mixed((sums[size:] - sums[:-size]) * np.cumprod(back, dtype=np.uint64))


def _picked(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest hash of some window of ``width`` hashes."""
    if len(hashes) < width:
        return np.empty(0, dtype=np.int64)
    minima = _sliding(np.minimum, hashes, width)
    ends = np.zeros(width - 1, dtype=np.uint64)
    reach = _sliding(np.maximum, np.concatenate([ends, minima, ends]), width)
    return np.flatnonzero((reach == hashes) & (hashes != _NONE))


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal, looked at in growing steps."""
    at, step = 0, 64
    n = min(len(a), len(b))
    while at < n:
        same = a[at : min(at + step, n)] == b[at : min(at + step, n)]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + len(same), step * 2
    return n


class _Found:
    """Runs by place; a stretch keeps the period it was first found with, the smallest."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}

    def add(self, start: int, length: int, period: int) -> None:
        self.period.setdefault((start, length), period)

    def inside(self, limit: int, size: int) -> list[tuple[int, int]]:
        return [(s, n) for (s, n), p in self.period.items() if p <= limit and n >= size]


def _short_periods(words: np.ndarray, found: _Found) -> None:
    for p in range(1, min(DIRECT, len(words))):
        same = np.zeros(len(words) - p + 2, dtype=np.int8)
        same[1:-1] = words[:-p] == words[p:]
        turns = np.flatnonzero(np.diff(same))
        starts, lengths = turns[::2], turns[1::2] - turns[::2] + p
        for i in np.flatnonzero(lengths >= max(WORDS, TIMES * p)):
            found.add(int(starts[i]), int(lengths[i]), p)


def _seeds(words: np.ndarray, width: int, periodic: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal picked grams, by distance and place."""
    size = 2 * width
    hashes = _gram_hashes(words, size)
    if periodic:
        marks = np.zeros(len(hashes) + 1, dtype=np.int64)
        for s, n in periodic:
            marks[s] += 1
            marks[s + n - size + 1] -= 1
        hashes[np.cumsum(marks[:-1]) > 0] = _NONE
    at = _picked(hashes, width)
    at = at[np.lexsort((at, hashes[at]))]
    key = hashes[at]
    places, gaps, step = [], [], 1
    while step < len(at):
        gap = at[step:] - at[:-step]
        near = (key[step:] == key[:-step]) & (gap < 2 * width)
        if not near.any():
            break
        ok = near & (gap >= width)
        places.append(at[:-step][ok])
        gaps.append(gap[ok])
        step += 1
    if not places:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    place, gap = np.concatenate(places), np.concatenate(gaps)
    by = np.lexsort((place, gap))
    return place[by], gap[by]


def _extended(words: np.ndarray, place: np.ndarray, gap: np.ndarray, found: _Found) -> None:
    last, upto = 0, -1
    for i, p in zip(place.tolist(), gap.tolist()):
        if p == last and i < upto:
            continue
        right = _agreeing(words[i:], words[i + p :])
        if not right:
            continue
        left = _agreeing(words[:i][::-1], words[p : i + p][::-1])
        last, upto = p, i + right
        if left + right + p >= max(WORDS, TIMES * p):
            found.add(i - left, left + right + p, p)


def _runs_of(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of several documents in one array; document ``d`` has ``sizes[d]`` words and a separator
    of its own at ``ends[d]``. Comes back as ``(start, length, period)`` in the array."""
    found = _Found()
    _short_periods(words, found)
    width = DIRECT
    while True:
        long = np.flatnonzero(sizes >= TIMES * width)
        if not len(long):
            break
        keep = np.zeros(len(words), dtype=bool)
        moved = np.zeros(len(words), dtype=np.int64)
        first = ends - sizes
        for d in long:
            keep[first[d] : ends[d] + 1] = True
        np.cumsum(keep[:-1], out=moved[1:])
        back = np.flatnonzero(keep)
        part = _Found()
        near = [(int(moved[s]), n) for s, n in found.inside(width // 2, 2 * width) if keep[s]]
        _extended(words[back], *_seeds(words[back], width, near), part)
        for (s, n), p in part.period.items():
            found.add(int(back[s]), n, p)
        width *= 2
    return sorted((s, n, p) for (s, n), p in found.period.items())


def find_in_texts(texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """``(n_words, runs, collapsed text)`` of each text."""
    split = [t.encode().split() if t else [] for t in texts]
    ids: defaultdict[bytes, int] = defaultdict(count(len(split)).__next__)
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    words = np.empty(int(sizes.sum()) + len(split), dtype=np.int64)
    for d, s in enumerate(split):
        words[ends[d] - len(s) : ends[d]] = list(map(ids.__getitem__, s))
        words[ends[d]] = d
    first = ends - sizes
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, p in _runs_of(words, ends, sizes):
        d = int(np.searchsorted(ends, s))
        runs[d].append((s - int(first[d]), n, p))
        gone[s + p] += 1
        gone[s + n] -= 1
    stays = np.cumsum(gone) == 0
    out = []
    for d, s in enumerate(split):
        kept = s if not runs[d] else [s[i] for i in np.flatnonzero(stays[first[d] : ends[d]])]
        out.append((len(s), runs[d], b" ".join(kept).decode()))
    return out


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length and period, by start, then period) and
    ``collapsed``, the text without the words that only repeat a run's first period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a longest stretch whose words equal those one period before,
    with its smallest period, at least four periods and six words long. Each row stands alone: repeated rows
    give the same answer, null and empty texts have no words, no runs and an empty collapsed text, an empty
    table an empty result. Texts of any length are read whole. A column of ``docs`` that bears the name of a
    new one is replaced; all others are kept as they are, whatever their names."""
    new = [f.name for f in _OUT]
    kept = [c for c in docs.columns if c not in new]
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([nested.schema["row"], *_OUT])
    types = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes = texts.cast(pa.large_binary()).to_pylist()
            lengths = [len(x or b"") for x in sizes]
            del sizes
            at = 0
            while at < batch.num_rows:
                upto, held = at + 1, lengths[at]
                while upto < batch.num_rows and held + lengths[upto] <= BATCH_BYTES:
                    held += lengths[upto]
                    upto += 1
                done = find_in_texts(texts.slice(at, upto - at).to_pylist())
                runs = pa.array(
                    [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in done], pa.list_(types)
                )
                columns = [batch.column(0).slice(at, upto - at), pa.array([n for n, _, _ in done], pa.int64()), runs]
                columns.append(pa.array([c for _, _, c in done], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["row", *new])
                at = upto

    out = nested.mapInArrow(work, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *new)
