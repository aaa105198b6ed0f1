"""Hand-computed cases for behaviour the driver tables do not reach."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cleaning as fc
from plumbline.functions import derive as fd
from plumbline.functions import numeric as fn
from plumbline.operators import bars, clean, cluster, encode, evaluate, graph, pairs, sampling, text, vectors
from plumbline.operators.joins import asof_join_ranked, contains_join
from plumbline.sources import tables
from plumbline.sources.text import read_text_corpus

T0 = dt.datetime(2024, 1, 1, 9, 30)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# --- sources ----------------------------------------------------------------------------------


def test_read_csv_distinct_and_exclude(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n1,a\n2,b\n")
    (tmp_path / "skip_me.csv").write_text("x,y\n9,z\n")
    df = tables.read_table(spark, "csv", str(tmp_path), schema="x int, y string", distinct=False)
    kept = tables.exclude_files(df, "^skip_")
    assert sorted(r["x"] for r in kept.collect()) == [1, 1, 2]
    assert tables.read_table(spark, "csv", str(tmp_path / "a.csv")).count() == 2


def test_text_corpus_falls_back_to_latin1(spark, tmp_path):
    (tmp_path / "AUP-v1.3.txt").write_bytes("Grüße".encode("latin-1"))
    (tmp_path / "plain.txt").write_text("héllo", encoding="utf-8")
    got = {r["doc_id"]: (r["version"], r["text"]) for r in read_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"AUP": ("1.3", "Grüße"), "plain": (None, "héllo")}


def test_conform_schema_reports(spark):
    df = spark.createDataFrame([("03/01/2020", "x", 1)], "d string, n string, extra int")
    target = T.StructType([T.StructField("day", T.DateType()), T.StructField("n", T.IntegerType()), T.StructField("z", T.DoubleType())])
    out, report = tables.conform_schema(df, target, {"d": "day"}, date_format="dd/MM/yyyy")
    assert out.first().asDict() == {"day": dt.date(2020, 1, 3), "n": None, "z": None}
    assert report == {"mapped": ["day", "n"], "missing": ["z"], "unused": ["extra"]}


# --- values -----------------------------------------------------------------------------------


def test_measures_and_clocks(spark):
    measures = [one(spark, fc.parse_measure(F.lit(v))) for v in ("T", "65s", " 0.5 ", "x", "")]
    assert measures == [0.0, 65.0, 0.5, None, None]
    assert one(spark, fd.hhmm_duration(F.lit(1050), F.lit(1210))) == 80
    assert one(spark, fd.hhmm_duration(F.lit(2350), F.lit(20))) == 30
    assert one(spark, fd.hhmm_to_ts(F.lit("2024-01-01").cast("date"), F.lit(2400))) is None
    assert one(spark, fd.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371.0088)


def test_drop_where_keeps_unknown_flags(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "id int, f int")
    assert sorted(r["id"] for r in clean.drop_where(df, "f").collect()) == [2, 3]


def test_impute_learns_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    test = spark.createDataFrame([(None,), (100.0,)], "v double")
    assert sorted(r["v"] for r in clean.impute_global(test, {"v": "median"}, train).collect()) == [2.0, 100.0]


def test_flat_bars_and_zero_spread_give_null(spark):
    df = spark.createDataFrame([("a", T0, 5.0), ("b", T0, 5.0)], "k string, ts timestamp, c double")
    assert [r["c_z"] for r in bars.cross_section_z(df, "ts", ["c"]).collect()] == [None, None]
    flat = fd.bar_shape(*[F.lit(2.0)] * 4)
    assert one(spark, flat["signed_range"]) is None and one(spark, flat["bar_range"]) == 0.0


def test_right_closed_bars(spark):
    rows = [("a", T0, 1.0), ("a", T0 + dt.timedelta(minutes=30), 2.0), ("a", T0 + dt.timedelta(minutes=31), 3.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    left = {r["bar"]: r["volume"] for r in bars.rebar(df, ["k"], "ts", "30 minutes", "v").collect()}
    right = {r["bar"]: r["volume"] for r in bars.rebar(df, ["k"], "ts", "30 minutes", "v", closed="right", label="right").collect()}
    assert left == {T0: 1, T0 + dt.timedelta(minutes=30): 2}
    assert right == {T0: 1, T0 + dt.timedelta(minutes=30): 1, T0 + dt.timedelta(minutes=60): 1}


def test_rolling_min_periods(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), float(i)) for i in range(4)], "k string, ts timestamp, v double")
    got = bars.rolling(df, ["k"], "ts", {"m": ("mean", "v", 3, 2)}).orderBy("ts").collect()
    assert [r["m"] for r in got] == [None, 0.5, 1.0, 2.0]


# --- joins ------------------------------------------------------------------------------------


def test_ranked_asof_prefers_rank_then_falls_back(spark):
    left = spark.createDataFrame([(1, "x", T0), (2, "y", T0)], "id int, place string, ts timestamp")
    sites = spark.createDataFrame([("x", "s1", 1), ("x", "s2", 2), ("y", "s1", 1), ("y", "s2", 2)], "place string, site string, rank int")
    obs = spark.createDataFrame([("s2", T0 - dt.timedelta(minutes=5), 7)], "site string, ts timestamp, v int")
    got = {r["id"]: (r["site"], r["r_v"]) for r in asof_join_ranked(left, sites, obs, "id", "place", "site", "ts", 3600).collect()}
    assert got == {1: ("s2", 7), 2: ("s2", 7)}
    strict = asof_join_ranked(left, sites, obs, "id", "place", "site", "ts", 3600, fallback=False)
    assert {r["site"] for r in strict.collect()} == {"s1"}


def test_contains_join_short_and_long(spark):
    long = "The quick brown fox jumps over the lazy dog near the river bank"
    a = spark.createDataFrame([(1, "xx " + long.upper() + " yy"), (2, "abc"), (3, "")], "a int, t string")
    b = spark.createDataFrame([(10, long), (11, "AbC"), (12, "quick"), (13, "zz abc zz")], "b int, t string")
    got = {(r["a"], r["b"]) for r in contains_join(a, b, "a", "t", "b", "t").collect()}
    assert got == {(1, 10), (1, 12), (2, 11), (2, 13)}


# --- sampling and evaluation ------------------------------------------------------------------


def test_hash_split_is_stable_under_new_rows(spark):
    parts = {"a": 0.5, "b": 0.5}
    small = {r["id"]: r["split"] for r in sampling.hash_split(spark.range(50), ["id"], parts).collect()}
    big = {r["id"]: r["split"] for r in sampling.hash_split(spark.range(500).repartition(5), ["id"], parts).collect()}
    assert all(big[i] == s for i, s in small.items())


def test_unseen_level_gets_the_global_mean(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "k string, y double")
    got = {r["k"]: r["k_encoded"] for r in encode.target_encode(train, spark.createDataFrame([("a",), ("z",)], "k string"), ["k"], "y", 1).collect()}
    assert got["z"] == pytest.approx(2 / 3) and got["a"] == pytest.approx((1 + 2 / 3) / 3)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    r = evaluate.auc(df, "s", "y").first()
    assert r["auc_roc"] == pytest.approx(0.875) and r["auc_pr"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_adaptive_blend_survives_saving(spark, tmp_path):
    stage = evaluate.AdaptiveBlend(inputCols=["a", "b"], threshold=5.0)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = evaluate.AdaptiveBlend.load(str(tmp_path / "stage"))
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double")
    assert [r["pred_adaptive"] for r in again.transform(df).collect()] == [1.0, 3.0]


def test_tail_probabilities():
    # Standard table values.
    assert fn.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert fn.t_tail(2.2281, 10) == pytest.approx(0.05, abs=1e-4)
    assert fn.chi2_tail(3.8415, 1) == pytest.approx(0.05, abs=1e-4)


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ np.array([2.0, -1.0]) + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    terms = {r["term"]: r for r in evaluate.ols_diagnostics(df, "y", ["a", "b"])["terms"].collect()}
    full = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    e = y - full @ beta
    inv = np.linalg.inv(full.T @ full)
    hc1 = np.sqrt(np.diag(inv @ (full.T * e**2) @ full @ inv * 200 / 197))
    for i, t in enumerate(("intercept", "a", "b")):
        assert terms[t]["estimate"] == pytest.approx(beta[i]) and terms[t]["hc1_error"] == pytest.approx(hc1[i])


# --- vectors and graphs -----------------------------------------------------------------------


@pytest.mark.parametrize("metric,pivots", [("cosine", 1), ("cosine", 6), ("euclid", 6), ("pearson", 4)])
def test_topk_equals_brute_force(spark, metric, pivots):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(120, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id int, v array<double>")
    got = vectors.vector_topk(df, df, 4, "v", "id", "id", metric, exclude_self=True, pivots=pivots, block=15)
    found = {(r["id"], r["rank"]): r["match_id"] for r in got.collect()}
    z = m - m.mean(axis=1, keepdims=True) if metric == "pearson" else m
    if metric == "euclid":
        sim = -np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    else:
        z = z / np.linalg.norm(z, axis=1, keepdims=True)
        sim = z @ z.T
    np.fill_diagonal(sim, -np.inf)
    best = np.argsort(-sim, axis=1)[:, :4]
    assert found == {(i, k + 1): int(best[i, k]) for i in range(120) for k in range(4)}


def test_normalise_bad_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<double>")
    assert [r["v"] for r in vectors.normalise_vectors(df, "v").collect()] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0]]


def test_synthetic_rows_lie_between_neighbours(spark):
    rows = [(i, 1 if i < 6 else 0, [float(i), float(i % 3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, y int, v array<double>")
    out = vectors.synthetic_minority(df, "y", 1, "v", "id", 2).collect()
    assert len(out) == 18
    at = {i: v for i, _, v in rows}
    for r in out:
        a, b = np.array(at[r["id"]]), np.array(at[r["match_id"]])
        assert np.allclose(a + (b - a) * r["mix"], r["v"])


def brute_betweenness(n, w):
    """All shortest paths by enumeration of simple paths."""
    load = dict.fromkeys(range(n), 0.0)
    for s, t in itertools.permutations(range(n), 2):
        best, paths = math.inf, []

        def walk(path, cost):
            nonlocal best, paths
            if cost > best + 1e-9:
                return
            if path[-1] == t:
                if cost < best - 1e-9:
                    best, paths = cost, []
                paths.append(list(path))
                return
            for v in range(n):
                if (path[-1], v) in w and v not in path:
                    walk([*path, v], cost + w[(path[-1], v)])

        walk([s], 0.0)
        for p in paths:
            for v in p[1:-1]:
                load[v] += 1 / len(paths)
    return {v: x / ((n - 1) * (n - 2)) for v, x in load.items()}


def test_betweenness_equals_enumeration(spark):
    w = {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 2.0, (2, 3): 1.0, (3, 0): 1.0, (1, 3): 2.0, (3, 4): 1.0, (4, 1): 1.0}
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src int, dst int, weight double")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(edges).collect()}
    want = brute_betweenness(5, w)
    assert all(got[v] == pytest.approx(want[v]) for v in want)


def test_communities_find_two_cliques(spark):
    pairs_ = [(a, b) for group in (range(4), range(4, 8)) for a, b in itertools.combinations(group, 2)] + [(3, 4)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs_], "src int, dst int, weight double")
    labels, q = graph.communities(edges)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert q == pytest.approx(graph.modularity(edges, labels)) and 0.3 < q < 0.5


def test_pagerank_mass(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    assert sum(r["pagerank"] for r in graph.pagerank(edges, iters=4).collect()) == pytest.approx(4.0)


def test_corr_matrix_with_gaps_and_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{e}", t, float(rng.normal())) for e in range(7) for t in range(30) if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "e string, t int, v double")
    got = {(r["entity_a"], r["entity_b"]): (r["n"], r["corr"]) for r in cluster.corr_matrix(df, "e", "t", "v", 5, 3, 8).collect()}
    table = {}
    for e, t, v in rows:
        table.setdefault(e, {})[t] = v
    assert len(got) == 21
    for (a, b), (n, r) in got.items():
        both = sorted(set(table[a]) & set(table[b]))
        want = np.corrcoef([table[a][t] for t in both], [table[b][t] for t in both])[0, 1]
        assert n == len(both) and r == pytest.approx(want)


# --- text -------------------------------------------------------------------------------------


def test_pii_labels_merge_and_redact(spark):
    rows = [(1, "mail a.b@c.org or 10.0.0.1"), (2, "ssn 123-45-6789 end"), (3, "nothing"), (4, None)]
    out = text.scan_pii(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    labels = {(r["id"], r["label"], r["value"]) for r in out["spans"].collect()}
    assert {(1, "EMAIL", "a.b@c.org"), (1, "IP_ADDRESS", "10.0.0.1"), (2, "SSN", "123-45-6789")} <= labels
    red = {r["id"]: r["redacted"] for r in out["redacted"].collect()}
    assert red[1] == "mail [REDACTED_EMAIL] or [REDACTED_IP_ADDRESS]" and red[3] == "nothing" and red[4] is None
    assert "123" not in red[2]


def test_chunks_cover_the_text(spark):
    words = [f"w{i}" for i in range(53)]
    df = spark.createDataFrame([(1, "  ".join(words)), (2, ""), (3, "one")], "id int, t string")
    got = text.chunk_documents(df, "id", "t", 10, 3).orderBy("chunk_no").collect()
    chunks = [r["chunk"].split() for r in got if r["id"] == 1]
    assert set(itertools.chain(*chunks)) == set(words)
    assert all(a[-3:] == b[:3] for a, b in zip(chunks, chunks[1:]) if len(a) == 10)
    assert [r["id"] for r in got].count(2) == 0 and [r["chunk"] for r in got if r["id"] == 3] == ["one"]


def test_rouge_and_bleu(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat on the mat"), ("a b", ""), ("x y z w", "x y z w")], "g string, a string")
    rows = pairs.bleu(pairs.rouge_l(df, "g", "a"), "g", "a").collect()
    assert rows[0]["rouge_l"] == pytest.approx(2 * (5 / 5) * (5 / 6) / (1 + 5 / 6))
    assert rows[1]["rouge_l"] == 0.0 and rows[1]["bleu"] == 0.0 and rows[2]["bleu"] == pytest.approx(1.0)
