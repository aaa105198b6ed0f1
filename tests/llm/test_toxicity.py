import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import toxicity
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    train = labels.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2)) == 0)
    model = toxicity.fit(docs, train)
    test = docs.join(labels.join(train, "doc_id", "left_anti"), "doc_id")
    got = [(model.at_least(r.text)[0] >= toxicity.DECISION, r.toxic) for r in test.collect()]
    bad = [x for x, y in got if y]
    good = [x for x, y in got if not y]
    assert np.mean(bad) > 0.7 and np.mean(good) < 0.02


def test_query_agrees_with_the_model(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in QUERIES["op5_ordinal_toxicity"](spark, SF).collect()}
    texts = docs.collect()
    assert len(rows) == len(texts)
    for d in texts:
        p = model.at_least(d.text)
        assert math.isclose(rows[d.doc_id].expected_severity, p.sum(), rel_tol=1e-9)
        assert all(a >= b for a, b in zip(p, p[1:])) and 0 <= p.sum() <= toxicity.GRADES
        assert rows[d.doc_id].toxic == (rows[d.doc_id].grade > 0)
    marked = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert sum(rows[i].toxic for i in marked) / len(marked) > 0.85


def test_gradient_and_order_of_thresholds():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(400):
        x = {j: 1.0 for j in range(4) if rng.random() < 0.4}
        eta = 2.0 * (0 in x) + 1.0 * (1 in x) - 1.0 * (2 in x)
        grades.append(int(np.sum(eta + rng.logistic() > np.array([0.0, 1.5, 3.0]))))
        rows.append(x)
    w, theta = toxicity.fit_cumulative_link(rows, np.array(grades), 4, 3, penalty=1e-4, steps=1500)
    assert abs(w[0] - 2) < 0.5 and abs(w[1] - 1) < 0.5 and abs(w[2] + 1) < 0.5 and abs(w[3]) < 0.5
    assert np.all(np.diff(theta) > 0) and abs(theta[0]) < 0.5


def test_odd_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(120):
        words = [rng.choice(["sun", "rain", "wind", "tree", "road"]) for _ in range(30)]
        if i % 3 == 0:
            words[i % 30] = "Vilest" + rng.choice(["a", "en", "ing"])
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(i % 3 == 0)))
    rows += [(500, None, 1), (501, "", 1), (None, "vilestx!", 1), (502, "tree " * 50000 + "vilestx", 1), (503, "road", 1), (503, "road", 1)]
    labels += [(None, 1), (7, None), (9, 1), (9, 1), (900, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.severity(d, toxicity.fit(d, y)).collect()
    flagged = [(r.doc_id) for r in out if r.toxic]
    assert flagged == [*range(0, 120, 3), None, 502] and len(out) == len(rows)
    kept = toxicity.drop_toxic(d, y)
    assert kept.columns == d.columns and kept.count() == len(rows) - len(flagged)
    none = toxicity.fit(d, y.limit(0))
    assert not any(r.toxic for r in toxicity.severity(d, none).collect())
    assert toxicity.severity(d.limit(0), none).count() == 0 and toxicity.drop_toxic(d.limit(0), y).count() == 0
