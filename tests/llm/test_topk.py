import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(same_as_sql):
    assert same_as_sql("op10_three_phase_topk", SF) > 0


def brute(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in ok]
    out = []
    for a, (i, x) in enumerate(ints):
        if i % 3:
            continue
        best = sorted((-sum(p * q for p, q in zip(x, y)), j) for b, (j, y) in enumerate(ints) if a != b and len(x) == len(y))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows_and_small_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, rng.gauss(0, 1)]) for _ in range(5)]) for i in range(120)]
    rows += [(3, rows[3][1]), (200, None), (201, []), (None, [0.1] * 5), (203, [1.0, None, 0, 0, 0]), (204, [math.nan] * 5)]
    rows += [(206, [math.inf, 0.0, 0, 0, 0]), (207, [1e6] * 5), (210, [0.5] * 2), (213, [0.75] * 2), (216, [-1e4] * 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 7) for i, v in rows], "vec_id long, embedding array<double>, score int")
    for k in (1, 4, 500):
        got = topk.top_k(df, F.col("vec_id") % 3 == 0, k)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0
