"""Graph metrics as joins and aggregations over edge lists. Loops cut their lineage in the shared
checkpoint folder; hub vertices are split by the adaptive skew join and map-side aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .frames import number_rows, rejoin
from .quantiles import quantile_values


def build_graph(df: DataFrame, src: str, dst: str, extra: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct vertices and weighted edges (rows per pair, plus ``extra`` aggregates)."""
    edges = df.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(
        F.col(src).alias("src"), F.col(dst).alias("dst")
    ).agg(F.count(F.lit(1)).alias("weight"), *[c.alias(n) for n, c in (extra or {}).items()])
    return vertices_of(edges), edges


def vertices_of(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("src", "dst")).alias("id")
    return edges.select(ends).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree by edge rows."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return edges.select(F.inline(ends)).groupBy("id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree")
    )


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Distinct neighbours over (vertices - 1), for departures and arrivals."""
    pairs = edges.select("src", "dst").distinct()
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    sides = pairs.select(F.inline(ends)).groupBy("id").agg(F.sum("o").alias("_o"), F.sum("i").alias("_i"))
    n = sides.agg(F.count(F.lit(1)).alias("_n"))
    other = F.nullif(F.col("_n") - 1, F.lit(0))
    return rejoin(sides, n, []).select(
        "id", (F.col("_o") / other).alias("out_centrality"), (F.col("_i") / other).alias("in_centrality")
    )


def pagerank(
    edges: DataFrame, reset: float = 0.15, iters: int = 10, weight: str | None = None,
    normalise: bool = True, every: int = 5,
) -> DataFrame:
    """PageRank after a fixed number of rounds: rank = reset + (1 - reset) x incoming shares,
    starting from 1. ``normalise`` scales the ranks to sum to the number of vertices, which makes
    up for what vertices without exits lose."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = edges.select("src", "dst", w.alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("_out"))
    share = cut_lineage(rejoin(e, out, ["src"]).select("src", "dst", (F.col("w") / F.col("_out")).alias("share")))
    verts = cut_lineage(vertices_of(edges))
    ranks = verts.withColumn("pagerank", F.lit(1.0))
    for i in range(iters):
        sent = (
            share.join(ranks.withColumnRenamed("id", "src"), "src")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("share") * F.col("pagerank")).alias("_in"))
        )
        ranks = verts.join(sent, "id", "left").select(
            "id", (F.lit(reset) + (1 - reset) * F.coalesce("_in", F.lit(0.0))).alias("pagerank")
        )
        if (i + 1) % every == 0 and i + 1 < iters:
            ranks = cut_lineage(ranks)
    if normalise:
        total = ranks.agg((F.count(F.lit(1)) / F.sum("pagerank")).alias("_f"))
        ranks = rejoin(ranks, total, []).select("id", (F.col("pagerank") * F.col("_f")).alias("pagerank"))
    return ranks


def betweenness(edges: DataFrame, weight: str = "weight", normalise: bool = True, batch: int = 256) -> DataFrame:
    """Weighted shortest-path betweenness of a directed graph.

    Sources go in batches, so the state of a round has ``batch`` x vertices rows; of a finished batch only a
    sum per vertex is kept. Within a batch all sources advance in step: distances relax until none
    improves, then shortest-path counts and dependencies spread along the edges that lie on
    shortest paths, one hop per round. Every round is a join and a sum."""
    e = cut_lineage(
        edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(F.col(weight).cast("double")).alias("w"))
    )
    ids = vertices_of(e)
    verts = cut_lineage(number_rows(ids, [], F.shiftright(F.xxhash64("id"), 54), [F.xxhash64("id"), F.col("id")], "no"))
    n = verts.count()
    load = verts.select("id", F.lit(0.0).alias("b"))
    for first in range(0, n, batch):
        some = verts.filter((F.col("no") > first) & (F.col("no") <= first + batch)).select("id")
        part = _source_loads(e, some)
        after = cut_lineage(load.unionByName(part).groupBy("id").agg(F.sum("b").alias("b")))
        release(part, load)
        load = after
    scale = 1.0 / ((n - 1) * (n - 2)) if normalise and n > 2 else 1.0
    return load.select("id", (F.col("b") * scale).alias("betweenness"))


def _source_loads(e: DataFrame, sources: DataFrame) -> DataFrame:
    """``(id, b)``: share of the shortest paths from ``sources`` that run through each vertex, summed."""
    own = [F.col("id").alias("s"), F.col("id").alias("v")]
    dist = cut_lineage(sources.select(*own, F.lit(0.0).alias("d")))
    frontier = dist
    while True:
        reached = (
            frontier.join(e, F.col("v") == F.col("src"))
            .groupBy("s", F.col("dst").alias("v"))
            .agg(F.min(F.col("d") + F.col("w")).alias("nd"))
        )
        better = reached.join(dist, ["s", "v"], "left").filter(
            F.col("d").isNull() | (F.col("nd") < F.col("d") - 1e-9 * F.greatest(F.col("d"), F.lit(1.0)))
        )
        fresh = cut_lineage(better.select("s", "v", F.col("nd").alias("d")))
        if fresh.isEmpty():
            break
        after = cut_lineage(dist.unionByName(fresh).groupBy("s", "v").agg(F.min("d").alias("d")))
        release(dist, frontier)
        dist, frontier = after, fresh

    tail = dist.select("s", F.col("v").alias("src"), F.col("d").alias("d_u"))
    head = dist.select("s", F.col("v").alias("dst"), F.col("d").alias("d_v"))
    near = 1e-9 * F.greatest(F.col("d_v"), F.lit(1.0))
    steps = cut_lineage(
        tail.join(e, "src").join(head, ["s", "dst"])
        .filter(F.abs(F.col("d_u") + F.col("w") - F.col("d_v")) <= near)
        .select("s", "src", "dst")
    )

    def spread(seed: DataFrame, start: str, end: str) -> DataFrame:
        """Sum of a value carried along 0, 1, 2, ... shortest-path edges."""
        total = wave = cut_lineage(seed)
        while True:
            moved = wave.withColumnRenamed("v", start).join(steps, ["s", start])
            after = cut_lineage(moved.groupBy("s", F.col(end).alias("v")).agg(F.sum("x").alias("x")))
            if after.isEmpty():
                return total
            both = cut_lineage(total.unionByName(after).groupBy("s", "v").agg(F.sum("x").alias("x")))
            release(total, wave)
            total, wave = both, after

    sigma = spread(sources.select(*own, F.lit(1.0).alias("x")), "src", "dst")
    back = spread(sigma.select("s", "v", (1.0 / F.col("x")).alias("x")), "dst", "src")
    both = sigma.join(back.withColumnRenamed("x", "g"), ["s", "v"]).filter("s <> v")
    out = cut_lineage(both.groupBy(F.col("v").alias("id")).agg(F.sum(F.col("x") * F.col("g") - 1).alias("b")))
    release(dist, frontier, fresh, steps, sigma, back)
    return out


def attach_metrics(df: DataFrame, key: str, metrics: DataFrame, cols: list[str]) -> DataFrame:
    """Vertex metrics joined to rows; rows without a vertex get the median over the rows."""
    side = metrics.select(F.col("id").alias(key), *cols)
    out = rejoin(df, side, [key])
    medians = quantile_values(out, {c: (c, 0.5) for c in cols})
    return out.fillna({c: v for c, v in medians.items() if v is not None})


def reachable(
    edges: DataFrame, start, depth: int, label: str | None = None, labels: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Edges within ``depth`` hops of ``start`` with the hop at which they are first used,
    optionally of certain labels. ``limit`` is the row cap of the report."""
    e = edges if labels is None else edges.filter(F.col(label).isin(*labels))
    frontier = edges.sparkSession.createDataFrame([(start,)], "src " + edges.schema["src"].dataType.simpleString())
    visited, found = frontier, None
    for hop in range(1, depth + 1):
        used = e.join(frontier, "src", "left_semi").withColumn("hop", F.lit(hop))
        found = used if found is None else found.unionByName(used)
        fresh = used.select(F.col("dst").alias("src")).distinct().join(visited, "src", "left_anti")
        frontier = cut_lineage(fresh)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return found.orderBy("hop", "src", "dst").limit(limit) if limit else found


# --- communities ------------------------------------------------------------------------------


def _undirected(edges: DataFrame, weight: str) -> DataFrame:
    """Both directions with summed weights; a loop keeps its weight once per direction."""
    w = F.col(weight).cast("double")
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.select(F.explode(ends).alias("p"), w.alias("w")).groupBy("p.a", "p.b").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, weight: str = "weight") -> float:
    """Newman modularity of a labelling ``(id, community)``; directions are ignored."""
    return _modularity(_undirected(edges, weight), labels)


def _modularity(both: DataFrame, labels: DataFrame) -> float:
    a = labels.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    b = labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    per = both.join(a, "a").join(b, "b").groupBy("ca").agg(
        F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside")
    )
    # Written, so that the shuffle files of the joins go at once.
    total = cut_lineage(per.agg(F.sum("k").alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk")))
    row = total.first()
    release(total)
    return row["i"] / row["m2"] - row["kk"] / row["m2"] ** 2 if row["m2"] else 0.0


def communities(
    edges: DataFrame, weight: str = "weight", sweeps: int = 8, levels: int = 10
) -> tuple[DataFrame, float]:
    """Modularity communities ``(id, community)`` and their modularity.

    Each sweep lets half of the vertices (by hash) move to the neighbouring community with the
    largest gain; a level ends when sweeps stop paying. Its communities then become the vertices of the
    next level, joined by the summed weights between them and to themselves by those inside, until no level gains
    or ``levels`` are done. The best labelling seen is returned."""
    both = cut_lineage(_undirected(edges, weight))
    final = None
    best_q = -1.0
    for _ in range(levels):
        labels, q = _moves(both, sweeps)
        if q <= best_q + 1e-9:
            release(labels)
            break
        best_q = q
        if final is None:
            final = cut_lineage(labels)
        else:
            up = labels.select(F.col("id").alias("community"), F.col("community").alias("_up"))
            after = cut_lineage(final.join(up, "community").select("id", F.col("_up").alias("community")))
            release(final)
            final = after
        a = labels.select(F.col("id").alias("a"), F.col("community").alias("ca"))
        b = labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
        after = cut_lineage(
            both.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))
        )
        release(both, labels)
        both = after
    release(both)
    return final, best_q


def _moves(both: DataFrame, sweeps: int) -> tuple[DataFrame, float]:
    strength = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    m2 = strength.agg(F.sum("k")).first()[0]
    labels = cut_lineage(strength.select("id", F.col("id").alias("community")))
    best, best_q, idle = labels, _modularity(both, labels), 0
    links = both.filter("a <> b")
    for sweep in range(sweeps):
        at = labels.select(F.col("id").alias("b"), F.col("community").alias("c"))
        pull = links.join(at, "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("kin"))
        stay = labels.select("id", F.col("community").alias("c"), F.lit(0.0).alias("kin"))
        pull = pull.unionByName(stay).groupBy("id", "c").agg(F.sum("kin").alias("kin"))
        totals = labels.join(strength, "id").groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("tot"))
        scored = pull.join(totals, "c").join(strength, "id").join(labels, "id")
        rest = F.col("tot") - F.when(F.col("c") == F.col("community"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("kin") - F.col("k") * rest / F.lit(m2), 9)
        # Ties go to the present community, then to the smallest id.
        target = scored.groupBy("id").agg(
            F.min_by("c", F.struct((-gain).alias("g"), (F.col("c") != F.col("community")).alias("o"), F.col("c").alias("c"))).alias("to")
        )
        turn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(sweep)), F.lit(2)) == 0
        moved = labels.join(target, "id").select(
            "id", F.when(turn, F.col("to")).otherwise(F.col("community")).alias("community")
        )
        after = cut_lineage(moved)
        if labels is not best:
            release(labels)
        labels = after
        q = _modularity(both, labels)
        if q > best_q + 1e-9:
            release(best)
            best, best_q, idle = labels, q, 0
        else:
            idle += 1
            if idle >= 2:
                break
    release(strength, *([labels] if labels is not best else []))
    return best, best_q
