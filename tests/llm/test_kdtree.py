import random
import zlib
from collections import defaultdict

import pytest

from plumbline.llm import kdtree
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def split(rows, dims, leaves, first=0, spread=None):
    """The same tree by sorting: rows are (dims..., tie, tie2, weight)."""
    spread = spread or [max(r[d] for r in rows) - min(r[d] for r in rows) for d in range(dims)]
    if leaves == 1 or not rows:
        return {r[dims:-1]: first for r in rows}
    wide = [(max(r[d] for r in rows) - min(r[d] for r in rows)) / (spread[d] or 1) for d in range(dims)]
    dim = wide.index(max(wide))
    order = sorted(rows, key=lambda r: (r[dim], r[dims], r[dims + 1]))
    target, total, at = sum(r[-1] for r in rows) * (leaves // 2) / leaves, 0, 0
    for at, r in enumerate(order):
        total += r[-1]
        if total >= target:
            break
    left = leaves // 2
    return split(order[: at + 1], dims, left, first, spread) | split(order[at + 1 :], dims, leaves - left, first + left, spread)


@pytest.mark.parametrize("leaves", [1, 2, 5, 16])
def test_tree_matches_sorting(spark, leaves):
    rng = random.Random(leaves)
    rows = [(rng.choice([1, 5, rng.randrange(10**6)]), rng.randrange(4), rng.randrange(3), i, rng.choice([1, 50, 400])) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, t long, i long, w long")
    got = kdtree.shards(df, ["a", "b"], "w", ("t", "i"), leaves=leaves)
    assert {(r.t, r.i): r.shard for r in got.collect()} == split(rows, 2, leaves)


def test_target_bytes_sets_the_leaves(spark):
    df = spark.range(1000).selectExpr("id as a", "id as t", "id as i", "10 as w")
    got = kdtree.shards(df, ["a"], "w", ("t", "i"), target=1200).groupBy("shard").count().collect()
    assert len(got) == 9 and all(abs(r["count"] - 1000 / 9) < 2 for r in got)


def test_query_laws(spark):
    rows = QUERIES["op3_kdtree_shards"](spark, SF).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in docs.items()}
    slots, size = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    most = max(r.size for r in rows)
    mean = sum(size.values()) / 16
    assert all(abs(size[k] - mean) <= 2 * most for k in range(16))


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (None, "", "en", 6), (2, "ab", "de", 7), (2, "ab", "de", 7), (3, "word " * 40000, None, 8), (-(1 << 63), "é", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int")
    out = kdtree.shard_documents(df, leaves=3).collect()
    assert sorted((r.doc_id or 0, r.size) for r in out) == [(-(1 << 63), 3), (0, 1), (1, 1), (2, 3), (2, 3), (3, 200001)]
    assert kdtree.shard_documents(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "same text") for i in range(160)], "doc_id long, text string")
    counts = kdtree.shard_documents(same).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in counts) == [10] * 16
