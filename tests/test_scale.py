"""Searches and pair joins whose disk, memory or tasks once grew with the square of the input."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import derive as fd
from plumbline.operators import graph, joins, vectors
from plumbline.session import shared_dir


def left_behind(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("plumbline-")}


def test_haversine_pairs_of_one_nation_go_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_ROWS", 20)
    monkeypatch.setattr(joins, "TASK_PAIRS", 500)
    sites = [(i, None if i == 3 else 7, float(i * 37 % 9000)) for i in range(90)]
    homes = [(i, 7 if i % 10 else 8, float(i * 91 % 9000)) for i in range(200)]
    spark.createDataFrame(sites, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(homes, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    out = entry.queries()["haversine_km"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.s_suppkey, r.c_custkey) for r in out} == {(s[0], c[0]) for s in sites for c in homes if s[1] == c[1]}
    assert len(out) == 89 * 180
    tasks = [r.task for r in out]
    assert max(map(tasks.count, set(tasks))) < len(out) / 4


def test_dealt_pairs_keep_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_ROWS", 3)
    a = spark.createDataFrame([(1, "x")] * 10 + [(2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, i % 2) for i in range(9)] + [(None, 5), (3, 1)], "j int, w int")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(joins.dealt_pairs(a, b, "k", "j")) == plain(a.join(b, F.col("k") == F.col("j")))


def test_round_fast_equals_round(spark):
    rng = random.Random(1)
    odd = [0.0, -0.0, 0.0005, 0.0015, 1.0005, 2.6755, 2.675, -1.2345, 1e300, float("nan"), float("inf"), float("-inf"), None, 4.0, 12.3455]
    df = spark.createDataFrame([(x,) for x in odd + [rng.random() * 20000 for _ in range(2000)]], "x double")
    rows = df.select(F.round("x", 3).alias("a"), fd.round_fast(F.col("x"), 3).alias("b")).collect()
    assert all(str(r.a) == str(r.b) for r in rows)


@pytest.mark.parametrize("metric", ["cosine", "pearson", "euclid"])
def test_search_copies_no_vectors_to_blocks(spark, monkeypatch, metric):
    """Several chunks of items, groups, copies of one vector; ties go to the smallest ids."""
    monkeypatch.setattr(vectors, "CHUNK", 2000)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(150, 6))
    m[40:80] = m[40]
    rows = [(i, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None, [1.0] * 6), (901, "a", None)]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>")
    out = vectors.vector_topk(df, df, 4, "v", "id", "id", metric, within="g", exclude_self=True, pivots=3, block=10)
    assert "CoGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["rank"]): r["match_id"] for r in out.collect()}
    z = m - m.mean(axis=1, keepdims=True) if metric == "pearson" else m
    z = z / np.linalg.norm(z, axis=1, keepdims=True) if metric != "euclid" else z
    for i in range(150):
        sim = -np.sqrt(((z - z[i]) ** 2).sum(1)) if metric == "euclid" else np.round(z @ z[i], 12)
        best = sorted((-sim[j], j) for j in range(150) if j != i and j % 2 == i % 2)[:4]
        assert [got[i, n] for n in range(1, 5)] == [j for _, j in best]
    assert len(got) == 600


def test_every_match_above_a_bound(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 1500)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(f"n{i:02d}", [float(x) for x in v]) for i, v in enumerate(m)], "id string, v array<double>")
    out = vectors.vector_topk(df, df, None, "v", "id", "id", min_sim=0.5, exclude_self=True, pivots=4, block=7).collect()
    z = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(f"n{i:02d}", f"n{j:02d}") for i in range(90) for j in range(90) if i != j and z[i] @ z[j] >= 0.5}
    assert {(r.id, r.match_id) for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("few", [500, 0])
def test_penalised_search_keeps_k_items_per_query(spark, monkeypatch, few):
    """Words looked for in each text or found by the containment join; null and empty texts and words."""
    monkeypatch.setattr(vectors, "FEW_WORDS", few)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(80, 5))
    text = ["Bad apple", "fine", None, "", "worse", "bad and WORSE"]
    rows = [(i, [float(x) for x in v], text[i % 6]) for i, v in enumerate(m)]
    words = [["BAD"], ["worse", None], [], None, [""], ["zzz", "apple"]]
    items = spark.createDataFrame(rows, "item long, v array<double>, text string")
    asked = spark.createDataFrame([(i, r[1], words[i % 6]) for i, r in enumerate(rows[:30])], "q long, v array<double>, cx array<string>")
    seen = []
    monkeypatch.setattr(vectors, "vector_topk", lambda *a, **b: seen.append(a))  # every match above a bound is not asked for
    out = vectors.match_with_penalty(asked, items, 3, "v", "q", "item", -1.0, "cx", "text", 0.4, pivots=3).collect()
    assert not seen
    got = {(r.q, r["rank"]): (r.item, round(r.score, 9)) for r in out}
    z = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(30):
        cx = [w.lower() for w in words[i % 6] or [] if w is not None]
        score = {j: z[i] @ z[j] - (0.4 if t is not None and any(w in t.lower() for w in cx) else 0) for j, _, t in rows}
        best = [j for j in sorted(score, key=lambda j: -score[j]) if score[j] >= -1][:3]
        assert [got[i, n + 1] for n in range(len(best))] == [(j, round(score[j], 9)) for j in best]


def test_grams_of_many_texts_are_not_broadcast(spark, monkeypatch):
    """The estimated size of the grams is that of a column of their texts, however many a text has."""
    monkeypatch.setattr(joins, "SENT_CHARS", 1000)
    rng = random.Random(2)
    long = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=60)) for _ in range(40)]
    short = [t[i % 50 : i % 50 + 40] for i, t in enumerate(long[:10])]
    docs = spark.createDataFrame([*enumerate(long)], "a int, t string")
    marks = spark.createDataFrame([*enumerate(short)], "b int, t string")
    plans, cut = [], joins.cut_lineage
    monkeypatch.setattr(joins, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    out = joins.contains_join(docs, marks, "a", "t", "b", "t")
    assert {(r.a, r.b) for r in out.collect()} == {(i, j) for i, t in enumerate(long) for j, u in enumerate(short) if u in t}
    semi = [p for p in plans if "LeftSemi" in p]
    assert len(semi) == 2 and "SortMergeJoin" in semi[1] and "BroadcastHashJoin" not in semi[1]


def test_communities_leave_only_their_labels(spark):
    rows = [(a, b, 1.0) for c in range(6) for a in range(c * 5, c * 5 + 5) for b in range(c * 5, a)] + [(c * 5, (c * 5 + 5) % 30, 0.1) for c in range(6)]
    before = left_behind(spark)
    labels, _ = graph.communities(spark.createDataFrame(rows, "src int, dst int, weight double"))
    assert labels.select("community").distinct().count() == 6
    assert len(left_behind(spark) - before) == 1


def test_modularity_without_edges(spark):
    edges = spark.createDataFrame([], "src int, dst int, weight double")
    assert graph.modularity(edges, spark.createDataFrame([], "id int, community int")) == 0.0


def test_neighbours_of_repeated_ids_in_several_chunks(spark, monkeypatch):
    """An id that two rows have counts twice on both sides; its bound once came from its own row."""
    monkeypatch.setattr(vectors, "CHUNK", 3000)
    rng = np.random.default_rng(11)
    m = rng.normal(size=(120, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    out = vectors.knn_similarity(df, 3, 0.1, "v", "id", pivots=4)
    assert "CoGroups" not in out._jdf.queryExecution().executedPlan().toString()
    z = m.astype("float32").astype("float64")
    z = z - z.mean(axis=1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = {}
    for i in range(120):
        near = [(-(z[i] @ z[j]), j) for j, _ in rows if j != i and z[i] @ z[j] >= 0.1] * sum(1 for j, _ in rows if j == i)
        want |= {(i, n): j for n, (_, j) in enumerate(sorted(near)[:3], 1)}
    assert {(r.id, r["rank"]): r.match_id for r in out.collect()} == want
