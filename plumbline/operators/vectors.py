"""Vector normalisation and exact top-k search.

Items are assigned to the nearest of a few pivot vectors, and the rows of each cell are packed into
blocks of bounded size. A query visits a cell only when the triangle inequality leaves room for a match, so
nothing is dropped, and a block pair is one matrix product inside a task that keeps at most ``k``
items per query.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage, release
from .frames import number_rows, rejoin
from .joins import _holding, meetings, top_k
from .quantiles import value_bucket
from .sampling import key_hash

BLOCK = 2000  # rows of one side in a block pair
CHUNK = 64 << 20  # bytes of item vectors, as doubles, that a task reads at a time
FEW_WORDS = 500  # counter-examples that are looked for in every text
_SLACK = 1e-6  # widens the pruning bound beyond rounding error


def normalise(v: Column) -> Column:
    """L2-normalised vector of doubles; a vector with NaN, infinity or zero length becomes zeros."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    good = ~F.isnan(norm) & (norm > 0) & (norm < float("inf"))
    return F.when(good, F.transform(x, lambda e: e / norm)).otherwise(F.transform(x, lambda e: F.lit(0.0)))


def normalise_vectors(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, normalise(F.col(column)))


def _matrix(m: np.ndarray, metric: str) -> np.ndarray:
    """Rows ready for the metric: unit length for cosine, centred first for pearson."""
    m = m.astype("float64")
    if metric == "pearson":
        m = m - m.mean(axis=1, keepdims=True)
    if metric != "euclid":
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        ok = np.isfinite(norms) & (norms > 0)
        m = np.where(ok, m / np.where(ok, norms, 1.0), 0.0)
    return m


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Metric distance for pruning: angle, or Euclidean length."""
    if metric == "euclid":
        sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(sq, 0.0))
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _reach(metric: str, bound: np.ndarray) -> np.ndarray:
    """Largest distance that can still satisfy the similarity bound."""
    if metric == "euclid":
        return -bound
    return np.arccos(np.clip(bound, -1.0, 1.0))


def _plain(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers where they are whole numbers without nulls, else as objects."""
    if pa.types.is_integer(x.type) and not x.null_count:
        return x.to_numpy(zero_copy_only=False)
    out = np.empty(len(x), dtype=object)
    out[:] = x.to_pylist()
    return out


def _order(ids: np.ndarray) -> np.ndarray:
    """Numbers that sort as the ids do, nulls first."""
    if ids.dtype != object:
        return ids
    place = {v: i for i, v in enumerate(sorted(set(ids), key=lambda v: (v is not None, v)))}
    return np.array([place[v] for v in ids], dtype=np.int64)


def _rows(column: pa.Array) -> np.ndarray:
    """The vectors of a column without nulls as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if n and (sizes != sizes[0]).any():
        raise ValueError("the vectors differ in length")
    return flat.astype("float32" if flat.dtype == np.float32 else "float64").reshape(n, -1)


class _Side:
    """One block's rows as the metric takes them."""

    def __init__(self, row: dict, tag: str, metric: str):
        self.ids = _plain(row[f"{tag}_ids"].values)
        self.order = _order(self.ids)
        kind = "float64" if row[f"{tag}_wide"].as_py() else "float32"
        self.m = _matrix(np.frombuffer(row[f"{tag}_m"].as_buffer(), kind).reshape(len(self.ids), -1), metric)
        # Single precision suffices to find candidates of unit length; their similarity is taken in double.
        self.fast = self.m if metric == "euclid" else self.m.astype("float32")
        self.sq = (self.m * self.m).sum(axis=1) if metric == "euclid" else None
        self.words: dict[str, int] | None = None
        if f"{tag}_terms" in row:  # each word once, and the rows and words that go together
            lists, self.words = row[f"{tag}_terms"].as_py(), {}
            self.at = np.array([i for i, x in enumerate(lists) for t in x or () if t is not None], dtype=np.int64)
            self.code = np.array([self.words.setdefault(t, len(self.words)) for x in lists for t in x or () if t is not None], dtype=np.int64)

    def marks(self, words: list[str]) -> np.ndarray:
        place = np.full(len(self.words), -1)
        place[[self.words[t] for t in words]] = np.arange(len(words))
        here = place[self.code] >= 0
        out = np.zeros((len(self.ids), len(words)), dtype="float32")
        out[self.at[here], place[self.code[here]]] = 1
        return out


def _hits(a: _Side, b: _Side) -> np.ndarray:
    """Whether a query and an item share a term."""
    both = sorted(a.words.keys() & b.words.keys())
    return a.marks(both) @ b.marks(both).T > 0


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of rows with rows; it does not depend on what else is in their blocks."""
    return -np.sqrt(((a - b) ** 2).sum(axis=1)) if metric == "euclid" else (a * b).sum(axis=1)


def _candidates(
    a: _Side, b: _Side, at: np.ndarray, floor: np.ndarray, k: int | None, metric: str, exclude_self: bool, penalty: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row of a, row of b, similarity, score)`` of the pairs of rows ``at`` whose score reaches the floor, all
    of the ``k`` best of a row among them; items stand in the order of their ids."""
    hit = _hits(a, b)[at] if a.words is not None else None
    if metric == "euclid":
        with np.errstate(invalid="ignore"):
            s = 2.0 * (a.m[at] @ b.m.T) - a.sq[at][:, None] - b.sq[None, :]
            size = a.sq[at] + np.max(b.sq[np.isfinite(b.sq)], initial=0.0)
        s[np.isnan(s)] = -np.inf
        slack = 1e-11 * np.where(np.isfinite(size), size, 0.0) + 1e-300
        least = np.where(floor > 0, np.inf, -(floor * floor)) - slack
    else:
        s = a.fast[at] @ b.fast.T
        if hit is not None:
            s -= np.float32(penalty) * hit
        slack = np.full(len(at), max(1e-5, 1.5e-7 * a.m.shape[1]))
        least = floor - slack
    if exclude_self:
        same = pd.DataFrame({"id": a.ids[at], "r": np.arange(len(at))}).merge(
            pd.DataFrame({"id": b.ids, "c": np.arange(len(b.ids))}), "inner", "id"
        )
        s[same["r"].to_numpy(), same["c"].to_numpy()] = -np.inf
    good = (s >= least[:, None].astype(s.dtype)) & (s > -np.inf)
    crowded = np.empty(0, np.int64)
    if k is not None and s.shape[1] > 2 * k:
        many = np.nonzero(good.sum(axis=1) > 2 * k)[0]
        if len(many):
            edge = np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * slack[many]
            good[many] &= s[many] >= edge[:, None].astype(s.dtype)
            crowded = many[good[many].sum(axis=1) > 8 * k]  # ties, of which the first ids count
    parts = []
    if len(crowded):
        for r in crowded:
            cols = np.nonzero(good[r])[0]
            sim = _exact(a.m[at[r]][None, :], b.m[cols], metric)
            score = sim if hit is None else sim - penalty * hit[r, cols]
            first = np.argsort(-score, kind="stable")[:k]
            parts.append((np.full(len(first), at[r]), cols[first], sim[first], score[first]))
        good[crowded] = False
    r, c = np.nonzero(good)
    for lo in range(0, len(r), 1 << 17):
        rr, cc = at[r[lo : lo + (1 << 17)]], c[lo : lo + (1 << 17)]
        sim = _exact(a.m[rr], b.m[cc], metric)
        parts.append((rr, cc, sim, sim if hit is None else sim - penalty * hit[r[lo : lo + (1 << 17)], cc]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
    rr, cc, sim, score = (np.concatenate(x) for x in zip(*parts))
    keep = score >= floor[np.searchsorted(at, rr)] - 1e-9
    return rr[keep], cc[keep], sim[keep], score[keep]


class _Best:
    """The best ``k`` items so far of each query of a block."""

    def __init__(self, row: dict, k: int, metric: str):
        self.row, self.k, self.side, self.no = row, k, _Side(row, "q", metric), row["q_no"].as_py()
        self.metric, self._dist = metric, None
        n = len(self.side.ids)
        self.tau = np.frombuffer(row["q_tau"].as_buffer(), "float64")
        self.score, self.sim = (np.frombuffer(row[c].as_buffer(), "float64").reshape(n, k) for c in ("top_score", "top_sim"))
        self.ids = _plain(row["top_ids"].values).reshape(n, k)

    def floor(self) -> np.ndarray:
        return np.maximum(self.tau, self.score[:, -1]) if self.k else self.tau

    def dist(self, centres: np.ndarray) -> np.ndarray:
        if self._dist is None:
            self._dist = _distance(self.side.m, centres, self.metric)
        return self._dist

    def now(self) -> dict[str, pa.Array]:
        """The columns that changed, as a row."""
        ids = self.row["top_ids"].values
        flat = pa.array(self.ids.ravel().tolist() if self.ids.dtype == object else self.ids.ravel(), ids.type)
        return {
            "top_ids": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
            "top_score": pa.array([self.score.tobytes()], pa.binary()),
            "top_sim": pa.array([self.sim.tobytes()], pa.binary()),
        }

    def add(self, rows: np.ndarray, ids: np.ndarray, sim: np.ndarray, score: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        n, k = len(touched), self.k
        r = np.concatenate([np.repeat(np.arange(n), k), np.searchsorted(touched, rows)])
        s = np.concatenate([self.score[touched].ravel(), score])
        m = np.concatenate([self.sim[touched].ravel(), sim])
        old = self.ids[touched].ravel()
        i = np.concatenate([old, ids] if old.dtype == ids.dtype else [old.astype(object), ids.astype(object)])
        held = s > -np.inf
        r, s, m, i = r[held], s[held], m[held], i[held]
        at = np.lexsort((_order(i), -s, r))
        r, s, m, i = r[at], s[at], m[at], i[at]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        if self.ids.dtype != i.dtype:
            self.ids = self.ids.astype(object)
        self.score, self.sim, self.ids = self.score.copy(), self.sim.copy(), self.ids.copy()
        self.score[touched] = -np.inf
        self.ids[touched] = None if self.ids.dtype == object else 0
        spot = (touched[r[top]], place[top])
        self.score[spot], self.sim[spot], self.ids[spot] = s[top], m[top], i[top]


def _found(q: np.ndarray, i: np.ndarray, sim: np.ndarray, score: np.ndarray, q_type: pa.DataType, i_type: pa.DataType) -> pa.RecordBatch:
    cols = [pa.array(x.tolist() if x.dtype == object else x, t) for x, t in ((q, q_type), (i, i_type))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(sim), pa.array(score)], ["_q", "_i", "similarity", "score"])


def vector_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int | None,
    vector: str,
    query_id: str,
    item_id: str,
    metric: str = "cosine",
    min_sim: float | None = None,
    within: str | None = None,
    exclude_self: bool = False,
    pivots: int | None = None,
    block: int = BLOCK,
    floor: str | None = None,
) -> DataFrame:
    """``(query_id, item_id, similarity, rank)`` of the best ``k`` items per query, exact.

    Similarity is the cosine, Pearson correlation or negative Euclidean distance. ``min_sim``
    drops weaker matches, ``within`` compares rows of the same group only, and ``k=None`` returns
    every match above ``min_sim``, or above the query's own bound in the column ``floor``."""
    if k is None and min_sim is None and floor is None:
        raise ValueError("give k, min_sim or floor")
    found = _search(queries, items, k, vector, query_id, item_id, metric, min_sim, within, exclude_self, pivots, block, floor)
    return _renamed(found.select("_q", "_i", "similarity"), query_id, item_id, k)


def _search(
    queries: DataFrame,
    items: DataFrame,
    k: int | None,
    vector: str,
    query_id: str,
    item_id: str,
    metric: str = "cosine",
    min_sim: float | None = None,
    within: str | None = None,
    exclude_self: bool = False,
    pivots: int | None = None,
    block: int = BLOCK,
    floor: str | None = None,
    terms: tuple[str, str] | None = None,
    penalty: float = 0.0,
) -> DataFrame:
    """``(_q, _i, similarity, score)``: per row of ``queries`` its best ``k`` items, or all above the bound. The
    score is the similarity, less ``penalty`` where the lists of words in the two columns ``terms`` meet.

    Both sides are packed into blocks, a row each, and blocks meet in a product that shuffles nothing. A chunk of the item
    blocks is read whole by each task, chunk after chunk, and a block of queries takes its best items so far along, so the
    disk holds each side once and ``k`` rows per query. Of a query's items those of its own cell come first."""
    lowest = -math.inf if metric == "euclid" else -1.0
    tau = F.col(floor).cast("double") if floor else F.lit(float(min_sim if min_sim is not None else lowest))
    g = F.col(within).cast("string") if within else F.lit("")
    both = lambda side: [F.col(terms[side]).alias("_w")] if terms else []
    asked = queries.select(F.col(query_id).alias("_id"), g.alias("_g"), F.col(vector).alias("_v"), tau.alias("_tau"), *both(0))
    offered = items.select(F.col(item_id).alias("_id"), g.alias("_g"), F.col(vector).alias("_v"), *both(1))
    needed = ["_v", *(["_id"] if exclude_self else [])]
    spark, cores = items.sparkSession, items.sparkSession.sparkContext.defaultParallelism
    x = cut_lineage(offered.dropna(subset=needed))
    n_items = x.count()
    n_pivots = pivots or int(max(1, math.sqrt(n_items / block)))
    # The lowest hashes are ranked alone; only the rows behind them bring their vectors along.
    low = x.select(key_hash(["_id"], 7).alias("h")).orderBy("h").limit(n_pivots).agg(F.max("h")).first()[0]
    some = x.filter(key_hash(["_id"], 7) <= F.lit(low)).orderBy(key_hash(["_id"], 7), "_id") if n_items else x.limit(0)
    drawn = [np.asarray(r["_v"], dtype=np.float64) for r in some.select("_v").limit(n_pivots).collect()]
    q_type, i_type = (df.schema["_id"].dataType for df in (asked, offered))
    names = f"_q {q_type.simpleString()}, _i {i_type.simpleString()}, similarity double, score double"
    if not drawn:
        return spark.createDataFrame([], names)
    centres = _matrix(np.stack(drawn), metric)

    def assign(batches):
        for b in batches:
            dist = _distance(_matrix(_rows(b.column("_v")), metric), centres, metric)
            near = dist.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(near, pa.int32()), pa.array(dist[np.arange(len(near)), near], pa.float64())],
                [*b.schema.names, "_cell", "_d"],
            )

    def packed(df: DataFrame, tag: str, rows: int, n: int, parts: int, extra: str, more) -> DataFrame:
        """Blocks of at most ``rows`` rows of one group and cell, in the order of their ids."""
        text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        spread = F.pmod(key_hash(["_id"], 11), F.lit(math.ceil(n / (rows * len(centres))) or 1))
        placed = df.mapInArrow(assign, f"{text}, _cell int, _d double")
        placed = placed.repartition(parts, "_g", "_cell", spread).sortWithinPartitions("_g", "_cell", "_id")
        id_type, wide = df.schema["_id"].dataType.simpleString(), df.schema["_v"].dataType.elementType.simpleString() != "float"

        def pack(batches):
            part, no, held, key = TaskContext.get().partitionId(), 0, [], None

            def out():
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                size = len(t)
                lists = lambda c: pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), t.column(c))
                cols = {
                    "g": t.column("_g").slice(0, 1), "cell": t.column("_cell").slice(0, 1), "ids": lists("_id"),
                    "m": pa.array([_rows(t.column("_v")).astype("float64" if wide else "float32").tobytes()], pa.binary()),
                    "wide": pa.array([wide]),
                } | ({"terms": lists("_w")} if terms else {})
                cols = {f"{tag}_{c}": v for c, v in cols.items()} | more(t, part, no)
                return pa.RecordBatch.from_arrays([*cols.values()], [*cols])

            for b in batches:
                cell = b.column("_cell").to_numpy()
                group = np.array(b.column("_g").to_pylist(), dtype=object)
                cuts = np.nonzero((cell[1:] != cell[:-1]) | (group[1:] != group[:-1]))[0] + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
                    while lo < hi:
                        have = sum(map(len, held))
                        if held and (key != (group[lo], cell[lo]) or have == rows):
                            yield out()
                            no, held, have = no + 1, [], 0
                        key, to = (group[lo], cell[lo]), min(hi, lo + rows - have)
                        held.append(b.slice(lo, to - lo))
                        lo = to
            if held:
                yield out()

        words = f", {tag}_terms array<array<string>>" if terms else ""
        return placed.mapInArrow(
            pack, f"{tag}_g string, {tag}_cell int, {tag}_ids array<{id_type}>, {tag}_m binary, {tag}_wide boolean{words}, {extra}"
        )

    n_chunks = math.ceil(n_items * centres.shape[1] * 8 / CHUNK)
    blocks = cut_lineage(packed(
        x, "i", block, n_items, n_chunks * math.ceil(cores / n_chunks), "i_radius double, i_chunk int",
        lambda t, part, no: {
            "i_radius": pa.array([np.nanmax(t.column("_d").to_numpy(), initial=0.0)], pa.float64()), "i_chunk": pa.array([part % n_chunks], pa.int32()),
        },
    ))
    release(x)
    radius = {r["i_cell"]: r["r"] for r in blocks.groupBy("i_cell").agg(F.max("i_radius").alias("r")).collect()}
    reach_of = np.array([radius.get(c, -math.inf) for c in range(len(centres))])
    first_only = k is not None and len(centres) > 1
    top = k or 0

    i_arrow = to_arrow_type(i_type)

    def begin(t, part, no):
        n = len(t)
        bound = t.column("_tau").to_numpy()
        if first_only:
            want = t.column("_cell").slice(0, 1).to_pylist()
        else:
            dist = _distance(_matrix(_rows(t.column("_v")), metric), centres, metric)
            want = np.nonzero((dist - reach_of <= _reach(metric, bound + min(0.0, penalty))[:, None] + _SLACK).any(axis=0))[0].tolist()
        empty = pa.array(np.zeros(n * top, "int64")).cast(i_arrow) if pa.types.is_integer(i_arrow) else pa.nulls(n * top, i_arrow)
        return {
            "q_tau": pa.array([bound.tobytes()], pa.binary()), "q_no": pa.array([(part << 32) + no], pa.int64()),
            "want": pa.array([want], pa.list_(pa.int32())),
            "top_ids": pa.ListArray.from_arrays(pa.array([0, n * top], pa.int32()), empty),
            "top_score": pa.array([np.full(n * top, -np.inf).tobytes()], pa.binary()),
            "top_sim": pa.array([np.full(n * top, -np.inf).tobytes()], pa.binary()),
        }

    q = cut_lineage(asked.dropna(subset=needed))
    n_queries = q.count()
    small = max(1, min(block, max(64, math.ceil(n_queries / (4 * cores)))))
    state = cut_lineage(packed(
        q, "q", small, n_queries, max(cores, min(8 * cores, math.ceil(n_queries / small))),
        f"q_tau binary, q_no bigint, want array<int>, top_ids array<{i_type.simpleString()}>, top_score binary, top_sim binary", begin,
    ))
    release(q)
    left_schema = state.schema
    left_names = state.columns
    none = spark.createDataFrame([(-1,)], "i_cell int")

    def meet(left: DataFrame, chunk: int) -> DataFrame:
        # A row without items stands at the end of a chunk, so each block of queries comes back.
        here = blocks.filter(F.col("i_chunk") == chunk).unionByName(none, allowMissingColumns=True).coalesce(1)
        pair = (F.col("q_g") == F.col("i_g")) & F.array_contains("want", F.col("i_cell"))
        return left.join(here.hint("shuffle_replicate_nl"), (F.col("i_cell") < 0) | pair)

    def compared(best: _Best, row: dict):
        """What an item block adds to a block of queries."""
        item, bound = _Side(row, "i", metric), best.floor()
        near = best.dist(centres)[:, row["i_cell"].as_py()] - row["i_radius"].as_py()
        at = np.nonzero(near <= _reach(metric, bound + min(0.0, penalty)) + _SLACK)[0]
        if not len(at):
            return None
        r, c, sim, score = _candidates(best.side, item, at, bound[at], k, metric, exclude_self, penalty)
        return r, item.ids[c], sim, score

    def pairs(batches):
        """``(row, its block of queries)``; a block of queries is read once while its rows follow each other."""
        best = None
        for b in batches:
            for j in range(len(b)):
                row = {c: b.column(c)[j] for c in b.schema.names}
                if best is None or best.no != row["q_no"].as_py():
                    if best is not None:
                        yield None, best
                    best = _Best(row, top, metric)
                if row["i_cell"].as_py() >= 0:
                    yield row, best
        if best is not None:
            yield None, best

    def merge(last: bool):
        def run(batches):
            for row, best in pairs(batches):
                if row is not None:
                    if (new := compared(best, row)) is not None:
                        best.add(*new)
                    continue
                want = best.row["want"].as_py()
                if last:
                    hit = best.dist(centres) - reach_of <= _reach(metric, best.floor() + min(0.0, penalty))[:, None] + _SLACK
                    want = [c for c in np.nonzero(hit.any(axis=0))[0].tolist() if c not in want]
                now = best.now() | {"want": pa.array([want], pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_arrays(
                    [now[c] if c in now else pa.array([best.row[c].as_py()], best.row[c].type) for c in left_names], left_names
                )

        return run

    if k is None:

        def every(batches):
            for row, best in pairs(batches):
                if row is not None and (new := compared(best, row)) is not None and len(new[0]):
                    r, ids, sim, score = new
                    yield _found(best.side.ids[r], ids, sim, score, best.row["q_ids"].values.type, i_arrow)

        return reduce(DataFrame.unionByName, [meet(state, c).mapInArrow(every, names) for c in range(n_chunks)])

    for last in [True, False] if first_only else [False]:
        for c in range(n_chunks):
            after = cut_lineage(meet(state, c).mapInArrow(merge(last and c == n_chunks - 1), left_schema))
            release(state)
            state = after

    def ended(batches):
        for b in batches:
            for j in range(len(b)):
                best = _Best({c: b.column(c)[j] for c in b.schema.names}, top, metric)
                r, p = np.nonzero(best.score > -np.inf)
                yield _found(best.side.ids[r], best.ids[r, p], best.sim[r, p], best.score[r, p], best.row["q_ids"].values.type, i_arrow)

    found = cut_lineage(state.mapInArrow(ended, names))
    release(state, blocks)
    return found


def _renamed(found: DataFrame, query_id: str, item_id: str, k: int | None) -> DataFrame:
    names = (query_id, item_id if item_id != query_id else f"match_{item_id}")
    if k is None:
        return found.select(F.col("_q").alias(names[0]), F.col("_i").alias(names[1]), "similarity")
    best = top_k(found, ["_q"], [F.desc("similarity"), F.col("_i")], k, "rank")
    return best.select(F.col("_q").alias(names[0]), F.col("_i").alias(names[1]), "similarity", "rank")


def cosine_topk(
    queries: DataFrame, items: DataFrame, k: int, vector: str, query_id: str, item_id: str,
    min_sim: float | None = None, within: str | None = None, **kw,
) -> DataFrame:
    return vector_topk(queries, items, k, vector, query_id, item_id, "cosine", min_sim, within, **kw)


def match_with_links(
    queries: DataFrame, items: DataFrame, links: DataFrame, k: int, vector: str, query_id: str,
    item_id: str, min_sim: float, within: str | None = None, **kw,
) -> DataFrame:
    """The best ``k`` items per query, of which direct links (a table of query and item ids) stay
    whatever their similarity and others need ``min_sim``; marked direct or inferred."""
    best = vector_topk(queries, items, k, vector, query_id, item_id, "cosine", None, within, **kw)
    other = item_id if item_id != query_id else f"match_{item_id}"
    known = links.select(query_id, other).distinct().withColumn("_l", F.lit(True))
    out = rejoin(best, known, [query_id, other])
    direct = F.coalesce("_l", F.lit(False))
    return out.filter(direct | (F.col("similarity") >= min_sim)).withColumn(
        "relation", F.when(direct, "direct").otherwise("inferred")
    ).drop("_l")


def match_with_penalty(
    queries: DataFrame, items: DataFrame, k: int, vector: str, query_id: str, item_id: str,
    min_sim: float, counter: str, text: str, penalty: float = 0.10, **kw,
) -> DataFrame:
    """Best ``k`` items per query by similarity minus ``penalty`` where the item text contains one
    of the query's counter-examples.

    Which counter-examples a text contains is settled once per item, so the search ranks by the score itself and
    keeps ``k`` items per query. Of an id that several rows have, each row counts with each."""
    other = item_id if item_id != query_id else f"match_{item_id}"
    asks = queries.withColumn("_cx", F.transform(counter, F.lower))
    texts = items.withColumn("_t", F.lower(text))
    words = asks.select(F.explode("_cx").alias("t")).distinct().dropna()
    offered = _contained(texts, words, "_t", "_has")
    found = _search(
        asks.dropna(subset=[query_id]), offered.dropna(subset=[item_id]), k, vector, query_id, item_id, "cosine", min_sim,
        terms=("_cx", "_has"), penalty=penalty, **kw,
    )
    for df, ident, c in ((queries, query_id, "_q"), (items, item_id, "_i")):
        often = df.groupBy(F.col(ident).alias(c)).agg(F.count(F.lit(1)).cast("int").alias("_n")).filter("_n > 1")
        times = F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))
        found = rejoin(found, often, [c]).withColumn("_n", F.explode(times)).drop("_n")
    kept = found.filter(F.col("score") >= min_sim)
    return top_k(kept, ["_q"], [F.desc("score"), F.col("_i")], k, "rank").select(
        F.col("_q").alias(query_id), F.col("_i").alias(other), "similarity", "score", "rank"
    )


def _contained(df: DataFrame, words: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the list of those ``words`` (a column ``t``) that the text contains. Few are looked for in every text, many
    by the join of texts that contain another."""
    few = [r["t"] for r in words.limit(FEW_WORDS + 1).collect()]
    if len(few) <= FEW_WORDS:
        each = F.array(*[F.lit(w) for w in few]).cast("array<string>")
        return df.withColumn(name, F.filter(each, lambda w: F.contains(F.col(text), w)))
    keyed = cut_lineage(df.withColumn("_h", F.md5(text)))
    big = keyed.filter(F.length(text) > 0).select(F.col("_h").alias("h"), F.col(text).alias("t")).dropDuplicates(["h"])
    small = words.filter(F.length("t") > 0).select(F.md5("t").alias("h"), "t")
    pairs = _holding(big, small, meetings(big, small)).join(small.withColumnRenamed("h", "small"), "small")
    held = pairs.groupBy(F.col("big").alias("_h")).agg(F.collect_set("t").alias(name))
    held = rejoin(keyed, held, ["_h"])
    # A text contains the empty word as well, which no other way finds.
    blank = words.filter(F.length("t") == 0).agg((F.count(F.lit(1)) > 0).alias("_blank"))
    every = F.when(F.col("_blank") & F.col(text).isNotNull(), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return rejoin(held, blank, []).withColumn(name, F.concat(F.coalesce(name, F.array().cast("array<string>")), every)).drop("_h", "_blank")


def knn_similarity(
    vectors: DataFrame, k: int, cutoff: float, vector: str, ident: str, metric: str = "pearson", **kw
) -> DataFrame:
    """Directed neighbour edges ``(ident, match_ident, similarity, rank)`` above ``cutoff``."""
    return vector_topk(vectors, vectors, k, vector, ident, ident, metric, cutoff, exclude_self=True, **kw)


# --- class balance on vectors -----------------------------------------------------------------


def synthetic_minority(
    df: DataFrame, label: str, minority, vector: str, ident: str, k: int = 5, needed: int | None = None,
    adaptive: bool = False, seed: int = 42, **kw,
) -> DataFrame:
    """New minority rows between a minority row and one of its ``k`` nearest minority rows.

    ``needed`` defaults to the gap to the largest class. Every row seeds about the same number, or
    with ``adaptive`` a number in proportion to the share of other classes among its ``k`` nearest
    rows. Base, neighbour and mixing factor come from hashes, so reruns agree."""
    few = df.filter(F.col(label) == F.lit(minority)).select(ident, vector)
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    own = counts.get(minority, 0)
    needed = max(counts.values()) - own if needed is None else needed
    near = vector_topk(few, few, k, vector, ident, ident, "euclid", exclude_self=True, **kw)
    other = f"match_{ident}"
    degree = near.groupBy(ident).agg(F.count(F.lit(1)).alias("_k"))
    if adaptive:
        around = vector_topk(
            few, df.select(ident, vector, label), k, vector, ident, ident, "euclid", exclude_self=True, **kw
        )
        labels = df.select(F.col(ident).alias(other), F.col(label).alias("_y"))
        hard = around.join(labels, other).groupBy(ident).agg(
            F.avg((F.col("_y") != F.lit(minority)).cast("double")).alias("_w")
        )
        total = hard.agg(F.sum("_w")).first()[0] or 0.0
        share = F.bround(F.col("_w") / F.lit(total) * needed) if total else F.lit(needed / max(own, 1))
        plan = hard.select(ident, share.cast("int").alias("_copies"))
    else:
        ranked = number_rows(
            few.select(ident).withColumn("_h", key_hash([ident], seed)), [],
            F.shiftright("_h", 48), [F.col("_h"), F.col(ident)], "_rn",
        )
        base, extra = divmod(needed, max(own, 1))
        plan = ranked.select(ident, (F.lit(base) + F.when(F.col("_rn") <= extra, 1).otherwise(0)).cast("int").alias("_copies"))
    drawn = (
        plan.join(degree, ident)
        .filter("_copies > 0")
        .select(ident, "_k", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
        .withColumn("rank", (F.pmod(key_hash([ident, "copy"], seed + 1), F.col("_k")) + 1).cast("int"))
        .withColumn("mix", key_hash([ident, "copy"], seed + 2) / F.lit(float(1 << 60)))
    )
    ends = drawn.join(near.select(ident, other, "rank"), [ident, "rank"])
    a = few.select(ident, F.col(vector).alias("_a"))
    b = few.select(F.col(ident).alias(other), F.col(vector).alias("_b"))
    both = ends.join(a, ident).join(b, other)
    line = F.zip_with("_a", "_b", lambda x, y: (x + (y - x) * F.col("mix")).cast("double"))
    return both.select(ident, other, "copy", "mix", line.alias(vector), F.lit(minority).alias(label))


def near_miss(
    df: DataFrame, label: str, minority, vector: str, ident: str, k: int = 3, version: int = 1, **kw
) -> DataFrame:
    """Minority rows plus as many other rows, chosen by closeness to the minority.

    Version 1 keeps those with the smallest mean distance to their ``k`` nearest minority rows.
    Version 3 first short-lists the ``k`` nearest other rows of every minority row, and of these
    keeps the ones with the largest mean distance."""
    few = df.filter(F.col(label) == F.lit(minority))
    many = df.filter(F.col(label) != F.lit(minority))
    pool = many
    if version == 3:
        short = vector_topk(few, many, k, vector, ident, ident, "euclid", **kw)
        pool = many.join(short.select(F.col(f"match_{ident}").alias(ident)).distinct(), ident, "left_semi")
    near = vector_topk(pool, few, k, vector, ident, ident, "euclid", **kw)
    mean = near.groupBy(ident).agg((-F.avg("similarity")).alias("mean_distance"))
    signed = mean.withColumn("_o", F.col("mean_distance") * (1 if version == 1 else -1))
    ranked = number_rows(signed, [], value_bucket(F.col("_o")), [F.col("_o"), F.col(ident)], "_n")
    wanted = few.agg(F.count(F.lit(1)).alias("n")).scalar()
    chosen = ranked.filter(F.col("_n") <= wanted).select(ident, "mean_distance")
    kept = many.join(chosen, ident)
    return kept.unionByName(few.withColumn("mean_distance", F.lit(None).cast("double")), allowMissingColumns=True)
