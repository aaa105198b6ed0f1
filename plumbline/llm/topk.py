"""Exact top-k inner products by three-phase uniform thresholds over partial-score lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.session import cut_lineage

#: Rows of a candidate block and of a query block; dimension segments, one partial-score list each.
CANDIDATES, QUERY_ROWS, SEGMENTS = 4096, 1024, 2


def _usable(c: Column) -> Column:
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~odd


def _blocks(rows: DataFrame, per_block: int, name: str) -> tuple[DataFrame, int]:
    """Rows packed as matrices, one row per (dim, block); the number of blocks follows the row count."""
    n = max(1, -(-rows.count() // per_block))
    block = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(name)

    def stack(t: pa.Table) -> pa.Table:
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table(
            {
                "dim": t.column("dim").slice(0, 1),
                name: t.column(name).slice(0, 1),
                f"{name}_rows": pa.array([np.ascontiguousarray(t.column("row").to_numpy()).tobytes()], pa.binary()),
                f"{name}_ids": pa.array([np.ascontiguousarray(t.column("id").to_numpy()).tobytes()], pa.binary()),
                f"{name}_x": pa.array([np.ascontiguousarray(x, dtype=np.int64).tobytes()], pa.binary()),
            }
        )

    schema = f"dim int, {name} int, {name}_rows binary, {name}_ids binary, {name}_x binary"
    return rows.select("dim", block, "row", "id", "x").groupBy("dim", name).applyInArrow(stack, schema), n


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, dim)


def _partials(q: np.ndarray, c: np.ndarray, segments: int) -> list[np.ndarray]:
    """Exact integer partial scores per dimension segment; floating point only where it is exact."""
    dim = q.shape[1]
    cuts = [dim * i // segments for i in range(segments + 1)]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if most < 2.0**53:
            out.append((q[:, a:b].astype(np.float64) @ c[:, a:b].astype(np.float64).T).astype(np.int64))
        else:
            out.append(q[:, a:b] @ c[:, a:b].T)
    return out


def _first_lists(t: dict, k: int, segments: int) -> dict[str, np.ndarray]:
    """Phase 1 in one block: whole scores of the entries that head some partial list, ``k`` per query at most."""
    dim = t["dim"]
    q, c = _matrix(t["qb_x"], dim), _matrix(t["cb_x"], dim)
    qrow, crow = np.frombuffer(t["qb_rows"], np.int64), np.frombuffer(t["cb_rows"], np.int64)
    parts = _partials(q, c, segments)
    own = qrow[:, None] == crow[None, :]
    whole = sum(parts)
    take = min(k + 1, len(c))
    seen = np.zeros(own.shape, dtype=bool)
    for p in parts:
        at = np.argpartition(-p, take - 1, axis=1)[:, :take]
        np.put_along_axis(seen, at, True, axis=1)
    seen &= ~own
    low = np.iinfo(np.int64).min
    held = np.where(seen, whole, low)
    best = np.partition(held, max(len(c) - k, 0), axis=1)[:, max(len(c) - k, 0) :]
    i, j = np.nonzero(best > low)
    return {"qrow": qrow[i], "score": best[i, j]}


def _sufficient(t: dict, segments: int, k: int) -> dict[str, np.ndarray]:
    """Phases 2 and 3 in one block: entries with a partial score of at least cutoff / segments in some list are
    collected, their whole scores resolved, and those that reach the cutoff returned."""
    dim = t["dim"]
    q, c = _matrix(t["qb_x"], dim), _matrix(t["cb_x"], dim)
    qrow, crow = np.frombuffer(t["qb_rows"], np.int64), np.frombuffer(t["cb_rows"], np.int64)
    low = np.iinfo(np.int64).min
    known = dict(zip((t["tau_rows"] or []), (t["taus"] or [])))
    tau = np.array([known.get(r, low) for r in qrow.tolist()], dtype=np.int64)
    uniform = -((-tau) // segments)  # integer scores: some part of a sum >= tau is >= ceil(tau / segments)
    uniform[tau == low] = low
    parts = _partials(q, c, segments)
    enough = np.zeros((len(q), len(c)), dtype=bool)
    for p in parts:
        enough |= p >= uniform[:, None]
    i, j = np.nonzero(enough)
    score = sum(p[i, j] for p in parts)
    keep = (score >= tau[i]) & (qrow[i] != crow[j])
    i, j, score = i[keep], j[keep], score[keep]
    cid = np.frombuffer(t["cb_ids"], np.int64)[j]
    by = np.lexsort((cid, -score, i))  # a block's own best k hold all of it that can be in the result
    i, j, score, cid = i[by], j[by], score[by], cid[by]
    first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    rank = np.arange(len(i)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(i) else i
    top = rank < k
    return {
        "qrow": qrow[i[top]],
        "query_id": np.frombuffer(t["qb_ids"], np.int64)[i[top]],
        "vec_id": cid[top],
        "score": score[top],
    }


def _over(pairs: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``work`` on every block pair, one pair in memory at a time."""

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                got = work({n: b.column(n)[at].as_py() for n in b.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[n])) for n in schema.names], schema.names)

    return pairs.mapInArrow(run, schema)


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    segments: int = SEGMENTS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row where ``queries`` holds, its ``k`` best other rows by the
    inner product of floor(scale * x), ties to the smaller id.

    Rows sit in blocks, whose score lists are split into ``segments`` partial lists by dimension. Phase 1 takes the
    heads of all partial lists; the k-th best whole score among them is a safe cutoff per query. Phase 2 collects the
    entries with a partial score of at least cutoff / segments: a row whose parts all lie below cannot reach the
    cutoff. Phase 3 resolves their scores exactly. The cutoff of a query reaches the blocks by a join.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id.
    Vectors of different lengths are not compared. Repeated rows count as rows of their own, and a repeated query is
    answered as often. Fewer candidates than ``k`` are all returned. Scores must fit 64 bits."""
    c = F.col(vector)
    ints = F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    clean = vectors.where(_usable(c) & F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.size(c).alias("dim"),
        ints.alias("x"),
        queries.alias("_asks"),
    )
    clean = cut_lineage(clean)
    asks = clean.where("_asks")
    q, n_q = _blocks(asks, QUERY_ROWS, "qb")
    d, n_c = _blocks(clean, CANDIDATES, "cb")
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    d = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    pairs = cut_lineage(q.join(d, ["dim", "qb", "cb"]))

    long = T.LongType()
    heads = T.StructType([T.StructField(n, long) for n in ("qrow", "score")])
    first = _over(pairs, lambda t: _first_lists(t, k, segments), heads)
    place = F.row_number().over(W.partitionBy("qrow").orderBy(F.desc("score")))
    cutoffs = first.withColumn("_r", place).where(F.col("_r") <= k).where(F.col("_r") == k).select("qrow", "score")
    blocked = cutoffs.withColumn("qb", F.pmod(F.xxhash64("qrow"), F.lit(n_q)).cast("int"))
    blocked = cut_lineage(
        blocked.groupBy("qb").agg(F.collect_list(F.struct("qrow", "score")).alias("c")).select(
            F.col("qb"), F.col("c.qrow").alias("tau_rows"), F.col("c.score").alias("taus")
        )
    )

    told = T.StructType([T.StructField(n, long) for n in ("qrow", "query_id", "vec_id", "score")])
    entries = _over(pairs.join(blocked, "qb", "left"), lambda t: _sufficient(t, segments, k), told)
    rank = F.row_number().over(W.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
