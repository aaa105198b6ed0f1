import math
from hashlib import sha256

import numpy as np
import pytest

from plumbline.llm import codes
from plumbline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, entries=256, parts=4, rounds=4):
    """Plain search over all entries in Python integers."""
    kept = [
        (i, [math.floor(1024 * float(x)) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for e, vs in members.items():
                books[p][e] = tuple(sum(col) // len(vs) for col in zip(*vs))
    final = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        (str(i), "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest)
        for (i, _, label), f, err in zip(kept, final, errors)
    )


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op12_norm_sum_codes"](spark, str(tmp_path)).collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got)


def clustered(n, seed, dims=16, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(int(i), [float(v) for v in np.float32(centres[rng.integers(12)] + spread * rng.normal(size=dims))], int(i) % 3) for i in range(n)]


@pytest.mark.parametrize("n", [5, 256, 900])
def test_equal_to_plain_search(spark, tmp_path, n):
    rows = clustered(n, n)
    assert run(spark, tmp_path, rows) == slow(rows)


def test_ties_repeats_nulls_and_odd_values(spark, tmp_path):
    rng = np.random.default_rng(8)
    grid = [(int(i), [float(x) / 4 for x in rng.integers(-2, 3, 8)], [None, 1, 2][i % 3]) for i in range(600)]
    odd = [
        (None, [0.25] * 8, None), (700, None, 1), (701, [float("nan")] + [0.0] * 7, 1), (702, [float("inf")] + [0.0] * 7, 1),
        (703, [None] + [0.0] * 7, 2), (5, [0.5] * 8, 1), (5, [0.5] * 8, 1), (5, [-0.5] * 8, 2),
    ]
    assert run(spark, tmp_path, grid + odd) == slow(grid + odd)


def test_empty_table_clashing_columns_and_other_lengths(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    rows = [(1, [0.5] * 8, 1, "a", 7), (2, [0.25] * 8, 1, "b", 8), (3, [0.5] * 4, 1, "c", 9)]
    df = spark.createDataFrame(rows, SCHEMA + ", x string, own int")
    done = codes.product_codes(df, parts=4)
    assert sorted((r.id, list(r.codes), r.error) for r in done.rows.collect()) == [(1, [0] * 4, 0), (2, [1] * 4, 0)]
    with pytest.raises(ValueError):
        codes.product_codes(df.limit(1), parts=3)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(v) for v in np.float32([200000.0 + i % 7, -180000.0, 1.5 * i, 0.0])], 1) for i in range(300)]
    got = codes.product_codes(spark.createDataFrame(rows, SCHEMA), entries=4, parts=2)
    with_slow = slow(rows, entries=4, parts=2)
    assert sorted((str(r.id), r.error) for r in got.rows.collect()) == sorted((i, e) for i, _, e, _, _ in with_slow)


def test_bounds_skip_scans_and_net_displacement_is_tighter(spark):
    rows = clustered(4000, 1, dims=8, spread=0.2)
    done = codes.product_codes(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=256, parts=2)
    assert done.scanned[0] == 1.0
    assert done.scanned[-1] < 0.8 and done.scanned[-1] <= done.scanned[1]
    there_and_back = np.zeros((3, 1, 1, 2), dtype=np.int64)
    there_and_back[1] = 100
    assert codes.displacements(there_and_back)[0, 0, 0] == 0  # drifts would have added up to 283


def test_query_equals_plain_search_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op12_norm_sum_codes"](spark, sf).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == slow(rows)


def test_query_equals_sql(same_as_sql):
    assert same_as_sql("op12_norm_sum_codes", "/root/testdata/sf0.01") == 500
