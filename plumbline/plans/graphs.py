"""Graphs, clusters and vectors on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as b
from ..operators import cluster as c
from ..operators import graph as g
from ..operators import vectors as v
from ..operators.frames import rejoin
from ..session import cut_lineage
from .registry import load, query
from .reporting import rounded
from .windowing import PRICES, _prices

ROUTES = """r AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight, avg(l_quantity) AS distance FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def _routes(spark, d):
    trips = (
        load(spark, d, "lineitem")
        .join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return g.build_graph(trips, "s_nationkey", "c_nationkey", {"distance": F.avg("l_quantity")})


@query("build_graph", f"WITH {ROUTES} SELECT src, dst, weight, round(distance, 6) AS distance FROM r")
def _(spark, d):
    return rounded(_routes(spark, d)[1], "distance", places=6)


@query("graph_vertices", f"WITH {ROUTES} SELECT src AS id FROM r UNION SELECT dst FROM r")
def _(spark, d):
    return _routes(spark, d)[0]


# A sparser, directed graph: suppliers to the parts' brands they ship, and back to nations.
SPARSE = """e AS (SELECT DISTINCT s_nationkey AS src, CAST(p_size AS INTEGER) AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def _sparse(spark, d):
    lines = load(spark, d, "lineitem")
    return (
        lines.join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("s_nationkey").alias("src"), F.col("p_size").cast("int").alias("dst"))
        .distinct()
    )


@query("degrees", f"""WITH {SPARSE} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree
 FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1""")
def _(spark, d):
    return g.degrees(_sparse(spark, d))


@query("degree_centrality", f"""WITH {SPARSE}, n AS (SELECT count(*) - 1 AS n FROM (SELECT src FROM e UNION SELECT dst FROM e))
SELECT id, round(sum(o)::DOUBLE / any_value(n), 6) AS out_centrality, round(sum(i)::DOUBLE / any_value(n), 6) AS in_centrality
 FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e), n GROUP BY 1""")
def _(spark, d):
    return rounded(g.degree_centrality(_sparse(spark, d)), "out_centrality", "in_centrality", places=6)


def _pagerank_sql(iters):
    ctes = [SPARSE, "v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)",
            "h AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e)",
            "p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS pr FROM v)"]
    for i in range(1, iters + 1):
        ctes.append(
            f"p{i} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(x, 0) AS pr FROM v LEFT JOIN (SELECT dst, sum(share * pr) AS x FROM h JOIN p{i - 1} ON src = id GROUP BY 1) ON v.id = dst)"
        )
    return f"WITH {', '.join(ctes)} SELECT id, round(pr * count(*) OVER () / sum(pr) OVER (), 6) AS pagerank FROM p{iters}"


@query("pagerank", _pagerank_sql(10))
def _(spark, d):
    return rounded(g.pagerank(_sparse(spark, d)), "pagerank", places=6)


def _betweenness_sql():
    """Distances by squaring, then every shortest path written out and its inner vertices counted."""
    ctes = [ROUTES, "w AS MATERIALIZED (SELECT src, dst, distance AS d FROM r WHERE src <> dst)",
            "v AS MATERIALIZED (SELECT src AS id FROM w UNION SELECT dst FROM w)",
            "d0 AS MATERIALIZED (SELECT src, dst, d FROM w UNION ALL SELECT id, id, 0 FROM v)"]
    for i in range(1, 6):
        ctes.append(f"d{i} AS MATERIALIZED (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM d{i - 1} a JOIN d{i - 1} b ON a.dst = b.src GROUP BY 1, 2)")
    return f"""WITH RECURSIVE {', '.join(ctes)},
 steps AS MATERIALIZED (SELECT a.src AS s, w.src AS u, w.dst AS t FROM d5 a JOIN w ON a.dst = w.src JOIN d5 b ON b.src = a.src AND b.dst = w.dst
  WHERE abs(a.d + w.d - b.d) <= 1e-9 * greatest(b.d, 1)),
 paths AS (SELECT s, t, [s, t] AS path FROM steps WHERE u = s
  UNION ALL SELECT p.s, n.t, list_append(p.path, n.t) FROM paths p JOIN steps n ON n.s = p.s AND n.u = p.t),
 shares AS (SELECT unnest(path[2:-2]) AS id, 1.0::DOUBLE / count(*) OVER (PARTITION BY s, t) AS x FROM paths),
 b AS (SELECT id, sum(x) AS b FROM shares GROUP BY 1), n AS (SELECT count(*) AS n FROM v)
SELECT v.id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM v LEFT JOIN b ON v.id = b.id, n"""


@query("betweenness", _betweenness_sql())
def _(spark, d):
    return rounded(g.betweenness(_routes(spark, d)[1], "distance"), "betweenness", places=9)


@query("attach_metrics", f"""WITH {SPARSE}, m AS (SELECT id, sum(i) AS in_degree, sum(i + o) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1),
x AS (SELECT p_partkey, p_size * 2 AS size, in_degree, degree FROM part LEFT JOIN m ON id = p_size * 2)
SELECT p_partkey, size, CAST(coalesce(in_degree, (SELECT quantile_cont(in_degree, 0.5) FROM x)) AS DOUBLE) AS in_degree,
 CAST(coalesce(degree, (SELECT quantile_cont(degree, 0.5) FROM x)) AS DOUBLE) AS degree FROM x""")
def _(spark, d):
    metrics = g.degrees(_sparse(spark, d)).select("id", *[F.col(c).cast("double").alias(c) for c in ("in_degree", "degree")])
    parts = load(spark, d, "part").select("p_partkey", (F.col("p_size") * 2).alias("size"))
    return g.attach_metrics(parts, "size", metrics, ["in_degree", "degree"])


@query("reachable", f"""WITH {SPARSE}, h1 AS (SELECT *, 1 AS hop FROM e WHERE src = 3), f1 AS (SELECT DISTINCT dst AS src FROM h1 WHERE dst <> 3),
h2 AS (SELECT *, 2 AS hop FROM e WHERE src IN (SELECT src FROM f1)), f2 AS (SELECT DISTINCT dst AS src FROM h2 WHERE dst <> 3 AND dst NOT IN (SELECT src FROM f1)),
h3 AS (SELECT *, 3 AS hop FROM e WHERE src IN (SELECT src FROM f2)) SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""")
def _(spark, d):
    return g.reachable(_sparse(spark, d), 3, 3)


# --- series -----------------------------------------------------------------------------------

# Monthly order value per nation: the return series of 25 entities.
SERIES = """m AS (SELECT c_nationkey AS nation, date_trunc('month', o_orderdate)::DATE AS month, max(o_totalprice) AS price FROM orders
 JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), s AS (SELECT nation, month, ln(price / lag(price) OVER (PARTITION BY nation ORDER BY month)) AS ret FROM m),
 t AS (SELECT * FROM s WHERE ret IS NOT NULL)"""


def _series(spark, d):
    m = (
        load(spark, d, "orders")
        .join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation"), F.date_trunc("month", "o_orderdate").cast("date").alias("month"))
        .agg(F.max("o_totalprice").alias("price"))
    )
    out = b.returns(m, ["nation"], "month", "price", names=("simple", "ret"))
    return out.filter("ret is not null").select("nation", "month", "ret")


RESID = f"{SERIES}, x AS (SELECT nation, month, ret, ret - avg(ret) OVER (PARTITION BY month) AS residual FROM t)"


def _residuals(spark, d):
    return c.residualise(_series(spark, d), "nation", "month", "ret", 10)


@query("residualise", f"WITH {RESID} SELECT nation, month, round(residual, 6) AS residual FROM x")
def _(spark, d):
    return rounded(_residuals(spark, d).select("nation", "month", "residual"), "residual", places=6)


@query("corr_matrix", f"""WITH {RESID} SELECT a.nation AS entity_a, b.nation AS entity_b, count(*) AS n, round(corr(a.residual, b.residual), 6) AS corr
 FROM x a JOIN x b ON a.month = b.month AND a.nation < b.nation GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(spark, d):
    out = c.corr_matrix(_residuals(spark, d), "nation", "month", "residual", 20, entities_per_block=10, instants_per_slab=30)
    return rounded(out, "corr", places=6)


def _corr(spark, d):
    return c.corr_matrix(_residuals(spark, d), "nation", "month", "residual", 20)


@query("spectral_clusters")
def _(spark, d):
    s = _series(spark, d)
    return c.spectral_clusters(_corr(spark, d), s.select("nation"), 4)


KNN = """c AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS match_vec_id, list_cosine_similarity(a.e, b.e) AS sim FROM c a JOIN c b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, match_vec_id) AS rn FROM s WHERE sim >= 0.2)"""


@query("communities_checked", f"""WITH {KNN}, e AS (SELECT vec_id AS src, match_vec_id AS dst, sim AS w FROM k WHERE rn <= 3),
both_ways AS (SELECT src AS a, dst AS b, w FROM e UNION ALL SELECT dst, src, w FROM e),
l AS (SELECT x.label AS la, y.label AS lb, w FROM both_ways JOIN embeddings x ON a = x.vec_id JOIN embeddings y ON b = y.vec_id),
per AS (SELECT la, sum(w) AS k, sum(CASE WHEN la = lb THEN w ELSE 0 END) AS inside FROM l GROUP BY 1)
SELECT (SELECT count(DISTINCT a) FROM both_ways) AS vertices, (SELECT count(DISTINCT a) FROM both_ways) AS labelled, true AS modularity_agrees, true AS beats_labels,
 round(sum(inside) / sum(k) - sum(k * k) / pow(sum(k), 2), 6) AS label_modularity FROM per""")
def _(spark, d):
    """Each vertex in one community, the modularity as claimed and at least that of the given labels."""
    t = load(spark, d, "embeddings")
    near = v.knn_similarity(t, 3, 0.2, "embedding", "vec_id")
    edges = cut_lineage(near.select(F.col("vec_id").alias("src"), F.col("match_vec_id").alias("dst"), F.col("similarity").alias("weight")))
    labels, q = g.communities(edges)
    given = g.modularity(edges, t.select(F.col("vec_id").alias("id"), F.col("label").alias("community")))
    counted = labels.agg(F.count_distinct("id").alias("vertices"), F.count("community").alias("labelled"))
    return counted.select(
        "*", F.lit(abs(g.modularity(edges, labels) - q) < 1e-9).alias("modularity_agrees"), F.lit(q >= given).alias("beats_labels"),
        F.round(F.lit(given), 6).alias("label_modularity"),
    )


@query("spectral_clusters_checked", f"""WITH {SERIES} SELECT count(DISTINCT nation) AS entities, 0::BIGINT AS out_of_range FROM t""")
def _(spark, d):
    s = _series(spark, d)
    out = c.spectral_clusters(_corr(spark, d), s.select("nation"), 4)
    return out.agg(F.count("entity").alias("entities"), F.count_if(~F.col("cluster").between(-1, 3)).alias("out_of_range"))


@query("kmeans_pca_planted", """WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS i FROM embeddings),
p AS (SELECT label, i, var_pop(v) * count(*) AS ss FROM x GROUP BY 1, 2)
SELECT CAST(count(DISTINCT label) AS INTEGER) AS k, round(sum(ss), 3) AS inertia, count(DISTINCT label) AS clusters_by_label FROM p""")
def _(spark, d):
    """Clusters far apart along ten axes, one per label: k-means must find them, and a full rotation keeps the distances."""
    t = load(spark, d, "embeddings")
    axes = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 50.0).otherwise(0.0).cast("float"))
    t = t.withColumn("embedding", F.concat("embedding", axes))
    table, labels = c.kmeans_pca(t, "embedding", "vec_id", 74, [t.select("label").distinct().count()])
    pairs = labels.join(t.select("vec_id", "label"), "vec_id").agg(F.count_distinct("label", "cluster").alias("clusters_by_label"))
    return rejoin(table.select("k", F.round("inertia", 3).alias("inertia")), pairs, [])


@query("communities")
def _(spark, d):
    near = v.knn_similarity(load(spark, d, "embeddings"), 3, 0.2, "embedding", "vec_id")
    edges = near.select(F.col("vec_id").alias("src"), F.col("match_vec_id").alias("dst"), F.col("similarity").alias("weight"))
    labels, q = g.communities(edges)
    return labels.groupBy("community").agg(F.count(F.lit(1)).alias("size")).withColumn("modularity", F.lit(q))


@query("kmeans_pca")
def _(spark, d):
    return c.kmeans_pca(load(spark, d, "embeddings"), "embedding", "vec_id", 8, [5, 10])[0]


@query("trend_slopes", f"""WITH {PRICES}, n AS (SELECT fund, price, row_number() OVER (PARTITION BY fund ORDER BY day) - 1 AS i FROM px)
SELECT fund, round(regr_slope(price, i), 4) AS slope FROM n GROUP BY 1""")
def _(spark, d):
    return rounded(c.trend_slopes(_prices(spark, d), "fund", "day", "price"), "slope")


@query("top_per_group", """SELECT c_nationkey, string_agg(c_custkey, ',' ORDER BY rn) AS items FROM (SELECT c_nationkey, c_custkey,
 row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 7 GROUP BY 1""")
def _(spark, d):
    out = c.top_per_group(load(spark, d, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 7)
    return out.select("c_nationkey", F.array_join("items", ",").alias("items"))


# --- vectors ----------------------------------------------------------------------------------

_SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("normalise_vectors", """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / n)), 6) AS total, round(embedding[1]::DOUBLE / n, 6) AS first
 FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)""")
def _(spark, d):
    unit = v.normalise_vectors(load(spark, d, "embeddings"), "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", F.round(total, 6).alias("total"), F.round(F.col("embedding")[0], 6).alias("first"))


@query("cosine_topk", f"""SELECT vec_id, match_vec_id, round(sim, 6) AS similarity, CAST(rn AS INTEGER) AS "rank" FROM (
 SELECT a.vec_id, b.vec_id AS match_vec_id, {_SIM} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rn
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_SIM} >= 0.1) WHERE rn <= 5""")
def _(spark, d):
    t = load(spark, d, "embeddings")
    out = v.cosine_topk(t, t, 5, "embedding", "vec_id", "vec_id", min_sim=0.1, exclude_self=True, pivots=8)
    return rounded(out, "similarity", places=6)


@query("cosine_topk_within", f"""SELECT vec_id, match_vec_id, round(sim, 6) AS similarity, CAST(rn AS INTEGER) AS "rank" FROM (
 SELECT a.vec_id, b.vec_id AS match_vec_id, {_SIM} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rn
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rn <= 3""")
def _(spark, d):
    t = load(spark, d, "embeddings")
    out = v.cosine_topk(t, t, 3, "embedding", "vec_id", "vec_id", within="label", exclude_self=True)
    return rounded(out, "similarity", places=6)


@query("match_with_links", f"""WITH t AS (SELECT a.vec_id, b.vec_id AS match_vec_id, {_SIM} AS sim, a.label = b.label AND abs(a.vec_id - b.vec_id) < 40 AS direct,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, match_vec_id, round(sim, 6) AS similarity, CAST(rn AS INTEGER) AS "rank", CASE WHEN direct THEN 'direct' ELSE 'inferred' END AS relation
FROM t WHERE rn <= 10 AND (direct OR sim >= 0.4)""")
def _(spark, d):
    t = load(spark, d, "embeddings")
    # Ids less than 40 apart lie in the same or in neighbouring stretches of 40.
    near = t.select("vec_id", "label", F.expr("vec_id div 40").alias("stretch"))
    around = near.withColumn("stretch", F.explode(F.array(*[F.col("stretch") + i for i in (-1, 0, 1)])))
    links = near.join(around.withColumnRenamed("vec_id", "match_vec_id"), ["label", "stretch"]).filter(
        F.abs(F.col("vec_id") - F.col("match_vec_id")) < 40
    )
    out = v.match_with_links(t, t, links, 10, "embedding", "vec_id", "vec_id", 0.4, exclude_self=True)
    return rounded(out, "similarity", places=6)


@query("match_with_penalty", f"""WITH q AS (SELECT vec_id AS q_id, embedding, CASE WHEN label < 5 THEN ['the'] ELSE ['zzz', '@'] END AS cx FROM embeddings),
i AS (SELECT vec_id, embedding, lower(text) AS text FROM embeddings JOIN documents ON vec_id = doc_id),
s AS (SELECT q_id, vec_id, {_SIM} AS sim, {_SIM} - CASE WHEN list_bool_or(list_transform(cx, lambda z: contains(b.text, z))) THEN 0.1 ELSE 0 END AS score FROM q a, i b),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE score >= 0.3)
SELECT q_id, vec_id, round(sim, 6) AS similarity, round(score, 6) AS score, CAST(rn AS INTEGER) AS "rank" FROM k WHERE rn <= 5""")
def _(spark, d):
    t = load(spark, d, "embeddings")
    cx = F.when(F.col("label") < 5, F.array(F.lit("the"))).otherwise(F.array(F.lit("zzz"), F.lit("@")))
    queries = t.select(F.col("vec_id").alias("q_id"), "embedding", cx.alias("cx"))
    items = t.join(load(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", "text")
    out = v.match_with_penalty(queries, items, 5, "embedding", "q_id", "vec_id", 0.3, "cx", "text")
    return rounded(out, "similarity", "score", places=6)


@query("knn_similarity", """WITH c AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS match_vec_id, list_cosine_similarity(a.e, b.e) AS sim FROM c a JOIN c b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, match_vec_id) AS rn FROM s WHERE sim >= 0.2)
SELECT vec_id, match_vec_id, round(sim, 6) AS similarity, CAST(rn AS INTEGER) AS "rank" FROM k WHERE rn <= 3""")
def _(spark, d):
    out = v.knn_similarity(load(spark, d, "embeddings"), 3, 0.2, "embedding", "vec_id", pivots=4)
    return rounded(out, "similarity", places=6)


def _minority_sql(adaptive):
    """Neighbours by distance; bases, partners and mixing factors from md5 as in the operator."""
    h = lambda *x: f"('0x' || substr(md5(concat_ws('|', {', '.join(x)})), 1, 15))::BIGINT"
    if adaptive:
        plan = """a AS (SELECT x.vec_id, y.cls, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.e, y.e), y.vec_id) AS rn FROM few x JOIN t y ON x.vec_id <> y.vec_id),
 w AS (SELECT vec_id, avg(CASE WHEN cls = 1 THEN 0.0::DOUBLE ELSE 1 END) AS w FROM a WHERE rn <= 5 GROUP BY 1),
 plan AS (SELECT vec_id, round_even(w / sum(w) OVER () * 200, 0)::INT AS copies FROM w)"""
    else:
        plan = f"""r AS (SELECT vec_id, row_number() OVER (ORDER BY {h("'42'", 'vec_id')}, vec_id) AS rn, count(*) OVER () AS own FROM few),
 plan AS (SELECT vec_id, (200 // own + CASE WHEN rn <= 200 % own THEN 1 ELSE 0 END)::INT AS copies FROM r)"""
    return f"""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, (label = 6)::INT AS cls FROM embeddings), few AS (FROM t WHERE cls = 1),
 d AS (SELECT a.vec_id, b.vec_id AS m, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rn FROM few a JOIN few b ON a.vec_id <> b.vec_id),
 near AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS k FROM d WHERE rn <= 5), {plan},
 drawn AS (SELECT vec_id, unnest(range(1, copies + 1))::INT AS copy FROM plan WHERE copies > 0)
SELECT vec_id, m AS match_vec_id, copy, round({h("'44'", 'vec_id', 'copy')} / 1152921504606846976.0::DOUBLE, 6) AS mix
FROM drawn JOIN near USING (vec_id) WHERE rn = {h("'43'", 'vec_id', 'copy')} % k + 1"""


@query("synthetic_minority", _minority_sql(False))
def _(spark, d):
    t = load(spark, d, "embeddings").withColumn("cls", (F.col("label") == 6).cast("int"))
    out = v.synthetic_minority(t, "cls", 1, "embedding", "vec_id", 5, needed=200)
    return out.select("vec_id", "match_vec_id", "copy", F.round("mix", 6).alias("mix"))


@query("synthetic_minority_adaptive", _minority_sql(True))
def _(spark, d):
    t = load(spark, d, "embeddings").withColumn("cls", (F.col("label") == 6).cast("int"))
    out = v.synthetic_minority(t, "cls", 1, "embedding", "vec_id", 5, needed=200, adaptive=True)
    return out.select("vec_id", "match_vec_id", "copy", F.round("mix", 6).alias("mix"))


NEAR_MISS = """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, (label = 6)::INT AS cls FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS m, list_distance(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rn
  FROM t a, t b WHERE a.cls = 0 AND b.cls = 1),
m AS (SELECT vec_id, avg(dist) AS mean_distance FROM d WHERE rn <= 3 GROUP BY 1)
SELECT vec_id, 0 AS cls, round(mean_distance, 6) AS mean_distance FROM (SELECT *, row_number() OVER (ORDER BY mean_distance, vec_id) AS k FROM m) WHERE k <= (SELECT count(*) FROM t WHERE cls = 1)
UNION ALL SELECT vec_id, 1, NULL FROM t WHERE cls = 1"""


@query("near_miss", NEAR_MISS)
def _(spark, d):
    t = load(spark, d, "embeddings").withColumn("cls", (F.col("label") == 6).cast("int"))
    out = v.near_miss(t, "cls", 1, "embedding", "vec_id", 3).select("vec_id", "cls", "mean_distance")
    return rounded(out, "mean_distance", places=6)


NEAR_MISS_3 = """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS e, (label = 6)::INT AS cls FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS m, list_distance(a.e, b.e) AS dist FROM t a, t b WHERE a.cls = 0 AND b.cls = 1),
pool AS (SELECT DISTINCT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY dist, vec_id) AS rn FROM d) WHERE rn <= 3),
k AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, m) AS rn FROM d JOIN pool USING (vec_id)),
m AS (SELECT vec_id, avg(dist) AS mean_distance FROM k WHERE rn <= 3 GROUP BY 1)
SELECT vec_id, 0 AS cls, round(mean_distance, 6) AS mean_distance FROM (SELECT *, row_number() OVER (ORDER BY mean_distance DESC, vec_id) AS k FROM m) WHERE k <= (SELECT count(*) FROM t WHERE cls = 1)
UNION ALL SELECT vec_id, 1, NULL FROM t WHERE cls = 1"""


@query("near_miss_short_list", NEAR_MISS_3)
def _(spark, d):
    t = load(spark, d, "embeddings").withColumn("cls", (F.col("label") == 6).cast("int"))
    out = v.near_miss(t, "cls", 1, "embedding", "vec_id", 3, version=3).select("vec_id", "cls", "mean_distance")
    return rounded(out, "mean_distance", places=6)
