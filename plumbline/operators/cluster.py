"""Correlation matrices, residuals, neighbour graphs of series, clusters and trends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .frames import days, number_rows, per_group, rejoin, slice_of
from .joins import top_k

ENTITIES = 500  # entities of one block of the correlation matrix
INSTANTS = 500  # instants of one slab of rows


def residualise(
    long: DataFrame, entity: str, ts: str, value: str, min_obs: int = 1, name: str = "residual"
) -> DataFrame:
    """Value minus the equal-weight mean of its instant, for entities with enough observations."""
    seen = long.filter(F.col(value).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    kept = long.join(seen.filter(F.col("_n") >= min_obs), entity, "left_semi")
    return per_group(kept, [ts], {"_m": F.avg(value)}).withColumn(name, F.col(value) - F.col("_m")).drop("_m")


def corr_matrix(
    long: DataFrame, entity: str, ts: str, value: str, min_periods: int = 2,
    entities_per_block: int = ENTITIES, instants_per_slab: int = INSTANTS,
) -> DataFrame:
    """Pairwise Pearson correlation over shared instants: ``(entity_a, entity_b, n, corr)``, a < b.

    Entities fall into blocks and instants into slabs; the values of a (block, slab) are packed into one tile, a
    dense matrix. Only tiles of a slab meet, only on their common instants, and each meeting is one matrix product
    that yields partial sums per pair of entities, which are added up. What is shuffled per pair of blocks is a
    tile, not the rows in it. Values are centred per entity first, for the accuracy of the sums."""
    rows = long.select(F.col(entity).alias("e"), F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))
    rows = rows.filter("v is not null and not isnan(v)")
    rows = per_group(rows, ["e"], {"_m": F.avg("v")}).select("e", "t", (F.col("v") - F.col("_m")).alias("v"))
    n_e, n_t = rows.agg(F.count_distinct("e"), F.count_distinct("t")).first()
    n_blocks = max(1, -(-n_e // entities_per_block))
    n_slabs = max(1, -(-n_t // instants_per_slab))
    tagged = rows.withColumns(
        {
            "b": F.pmod(F.xxhash64("e"), F.lit(n_blocks)).cast("int"),
            "slab": F.pmod(F.xxhash64("t"), F.lit(n_slabs)).cast("int"),
        }
    )
    kind, at = (rows.schema[c].dataType.simpleString() for c in "et")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="t", columns="e", values="v", aggfunc="first")
        cells = wide.to_numpy(dtype="float64").tobytes()
        return pd.DataFrame(
            {"b": pdf["b"].iloc[:1], "slab": pdf["slab"].iloc[:1], "es": [list(wide.columns)], "ts": [list(wide.index)], "m": [cells]}
        )

    tiles = cut_lineage(
        tagged.groupBy("b", "slab").applyInPandas(pack, f"b int, slab int, es array<{kind}>, ts array<{at}>, m binary")
    )
    present = tiles.groupBy("slab").agg(F.collect_set("b").alias("bs"))  # at most n_blocks numbers
    meeting = F.transform("bs", lambda o: F.struct(F.least(o, F.col("b")).alias("lo"), F.greatest(o, F.col("b")).alias("hi")))
    spread = tiles.join(present, "slab").withColumn("p", F.explode(meeting)).select("p.lo", "p.hi", "slab", "b", "es", "ts", "m")

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        rows_of = {int(r.b): r for r in pdf.itertuples()}
        left, right = rows_of[lo], rows_of[hi]
        place = {t: i for i, t in enumerate(right.ts)}
        common = [(i, place[t]) for i, t in enumerate(left.ts) if t in place]

        def parts(tile, keep):
            m = np.frombuffer(tile.m).reshape(len(tile.ts), len(tile.es))[keep]
            seen = ~np.isnan(m)
            return np.where(seen, m, 0.0), seen.astype("float64")

        (x, mx), (y, my) = parts(left, [i for i, _ in common]), parts(right, [j for _, j in common])
        n = mx.T @ my
        a, b = np.meshgrid(np.arange(len(left.es)), np.arange(len(right.es)), indexing="ij")
        la, rb = np.array(list(left.es), dtype=object), np.array(list(right.es), dtype=object)
        out = pd.DataFrame(
            {
                "a": la[a.ravel()], "b": rb[b.ravel()], "n": n.ravel(),
                "sx": (x.T @ my).ravel(), "sy": (mx.T @ y).ravel(), "sxy": (x.T @ y).ravel(),
                "sxx": ((x * x).T @ my).ravel(), "syy": (mx.T @ (y * y)).ravel(),
            }
        )
        out = out[out["n"] > 0]
        if lo == hi:
            return out[out["a"] < out["b"]]
        swap = out["a"] > out["b"]
        flipped = out[swap].rename(columns={"a": "b", "b": "a", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"})
        return pd.concat([out[~swap], flipped[out.columns]])

    sums = ", ".join(f"{c} double" for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))
    cells = spread.groupBy("lo", "hi", "slab").applyInPandas(partial, f"a {kind}, b {kind}, {sums}")
    total = cells.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = cov / F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))), F.lit(0.0))
    return total.filter(n >= min_periods).select(
        F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), n.cast("long").alias("n"), r.alias("corr")
    )


def spectral_clusters(
    affinity: DataFrame, entities: DataFrame, k: int, a: str = "entity_a", b: str = "entity_b",
    weight: str = "corr", iters: int = 20,
) -> DataFrame:
    """Clusters from non-negative affinities by power iteration; entities without any positive
    affinity (too short a series, for example) get -1."""
    ids = entities.select(F.col(entities.columns[0]).alias("entity")).distinct()
    numbered = number_rows(ids, [], F.shiftright(F.xxhash64("entity"), 54), [F.xxhash64("entity"), F.col("entity")], "no")
    edges = affinity.filter(F.col(weight) > 0).select(a, b, weight)
    left = numbered.select(F.col("entity").alias(a), F.col("no").alias("src"))
    right = numbered.select(F.col("entity").alias(b), F.col("no").alias("dst"))
    graph = edges.join(left, a).join(right, b).select("src", "dst", F.col(weight).cast("double").alias("w"))
    pic = PowerIterationClustering(k=k, maxIter=iters, initMode="degree", weightCol="w")
    found = pic.assignClusters(graph).select(F.col("id").alias("no"), "cluster")
    return rejoin(numbered, found, ["no"]).select("entity", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def kmeans_pca(
    df: DataFrame, vector: str, ident: str, dims: int, ks: list[int], seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """PCA, then k-means for every k: inertia and silhouette per k, and the labels of the best k."""
    vectors = df.select(ident, array_to_vector(F.transform(vector, lambda e: e.cast("double"))).alias("_raw"))
    reduced = PCA(k=dims, inputCol="_raw", outputCol="features").fit(vectors).transform(vectors)
    reduced = cut_lineage(reduced.select(ident, "features"))  # read again for every k
    rows, best = [], (None, -2.0)
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(reduced)
        labelled = model.transform(reduced)
        score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labelled)
        rows.append((k, float(model.summary.trainingCost), float(score)))
        if score > best[1]:
            best = (labelled.select(ident, "cluster"), score)
    table = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")
    return table, best[0]


def trend_slopes(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Regression slope of the value on its position (0, 1, 2, ...) in the series of the key."""
    dated = number_rows(df, [key], slice_of(days(ts), 365), [F.col(ts)], "_no")
    x = (F.col("_no") - 1).cast("double")
    return dated.groupBy(key).agg(F.regr_slope(F.col(value), x).alias("slope"))


def top_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 7) -> DataFrame:
    """The ``n`` best items of each group as an ordered array."""
    best = top_k(df, [group], [F.desc(score), F.col(item)], n, "_r")
    items = F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda x: x[item])
    return best.groupBy(group).agg(items.alias("items"))
