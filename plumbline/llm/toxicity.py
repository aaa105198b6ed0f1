"""Severity of toxic language by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.names import free_name
from plumbline.session import cut_lineage, release

#: Labelled rows that a model is fitted on at most, features it keeps at most.
SAMPLE_ROWS, FEATURES = 20_000, 4096
GRADES = 3
#: Probability from which a grade counts as reached.
DECISION = 0.4
_LETTERS = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6)
_WORDS_HELD = 500_000


def word_features(word: str) -> list[str]:
    """The word itself and its proper prefixes; a prefix stands for the forms of a stem."""
    return ["=" + word, *(word[:k] for k in _PREFIXES if len(word) > k)]


def text_features(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            out[f] += n
    return out


def words_of(text: str | None) -> Counter:
    return Counter(_LETTERS.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k - 1]) with one weight vector for all thresholds."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    _known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def vector(self, words: Counter) -> dict[int, int]:
        """Occurrences by feature number."""
        if len(self._known) > _WORDS_HELD:
            self._known.clear()
        known, out = self._known, {}
        for w, n in words.items():
            has = known.get(w)
            if has is None:
                has = tuple(self.vocabulary[f] for f in word_features(w) if f in self.vocabulary)
                if len(w) <= 64:
                    known[w] = has
            for j in has:
                out[j] = out.get(j, 0) + n
        return out

    def at_least(self, text: str | None) -> np.ndarray:
        """Probabilities of the grades 1, 2, ... or more."""
        x = self.vector(words_of(text))
        eta = sum(self.weights[j] * (1.0 + math.log(n)) for j, n in sorted(x.items()))
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - eta, -500, 500)))


def fit_cumulative_link(
    rows: list[dict[int, float]], grades: np.ndarray, size: int, levels: int, penalty: float = 1e-4, steps: int = 400
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by penalised maximum likelihood (full-batch Adam, so runs repeat)."""
    index = np.array([j for r in rows for j in r], dtype=np.int64)
    value = np.array([v for r in rows for v in r.values()], dtype=np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = len(rows)
    share = np.clip([(grades >= k).mean() for k in range(1, levels + 1)], 1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    # thresholds: the first one, then logs of the steps between them
    params = np.concatenate([np.zeros(size), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    low, high = grades - 1, grades  # thresholds on either side of a grade
    for t in range(1, steps + 1):
        w, gaps = params[:size], np.exp(params[size + 1 :])
        theta = np.concatenate([[params[size]], params[size] + np.cumsum(gaps)])
        eta = np.bincount(owner, w[index] * value, minlength=n)
        sig = 1.0 / (1.0 + np.exp(np.clip(theta[None, :] - eta[:, None], -60, 60)))
        wide = np.concatenate([np.ones((n, 1)), sig, np.zeros((n, 1))], axis=1)
        a, b = wide[np.arange(n), low + 1], wide[np.arange(n), high + 1]
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        g_eta = (da - db) / n
        g_theta = np.zeros(levels + 2)
        np.add.at(g_theta, low + 1, -da / n)
        np.add.at(g_theta, high + 1, db / n)
        g_theta = g_theta[1:-1]
        grad = np.concatenate(
            [
                np.bincount(index, g_eta[owner] * value, minlength=size) - penalty * w,
                [g_theta.sum()],
                np.cumsum(g_theta[::-1])[::-1][1:] * gaps,
            ]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    theta = np.concatenate([[params[size]], params[size] + np.cumsum(np.exp(params[size + 1 :]))])
    return params[:size], theta


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, rows: int) -> DataFrame:
    """Labelled distinct texts of at most ``rows`` ids, chosen by hash; the ids are few enough to broadcast."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    named = named.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
    few = named.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    held = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    held = held.join(F.broadcast(few), "_id")
    return held.groupBy(F.xxhash64("_text").alias("_h")).agg(F.first("_text").alias("_text"), F.max("_y").alias("_y"))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, features: int = FEATURES,
) -> OrdinalModel:
    """A model from 0/1 labels of at most ``sample_rows`` documents, each distinct text once.

    Features (words and word prefixes) are kept if toxic texts hold them at least three times as often as clean ones
    and clearly not by chance, strongest first. Clean texts have grade 0; toxic ones have grade 1, 2 or 3 by the third
    that their number of words with such features falls into. Without both kinds of text every grade is 0."""
    sample = cut_lineage(_sample(docs, labels, id_col, text, label, sample_rows))
    total = {r._y: r.n for r in sample.groupBy((F.col("_y") > 0).alias("_y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(True, 0), total.get(False, 0)
    if not bad or not good:
        release(sample)
        return OrdinalModel({}, np.zeros(0), np.full(GRADES, 60.0))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for t, y in zip(b.column("_text").to_pylist(), b.column("_y").to_pylist()):
                seen[y > 0].update(text_features(words_of(t)).keys())
            names = list(seen[True])  # a feature of no toxic text is never kept
            clean = list((seen[False] - Counter()).items())
            yield pa.RecordBatch.from_pydict(
                {
                    "f": names + [f for f, _ in clean],
                    "bad": [seen[True][f] for f in names] + [0] * len(clean),
                    "good": [0] * len(names) + [n for _, n in clean],
                },
                schema=pa.schema([("f", pa.string()), ("bad", pa.int64()), ("good", pa.int64())]),
            )

    counts = sample.select("_text", "_y").mapInArrow(held, "f string, bad long, good long")
    counts = counts.groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    p, q = F.col("bad") / bad, F.col("good") / good
    both = (F.col("bad") + F.col("good")) / (bad + good)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / bad + 1 / good))
    kept = counts.where((F.col("bad") >= max(3, bad // 500)) & (p > 3 * q)).withColumn("z", z).where("z >= 4")
    vocabulary = {r.f: i for i, r in enumerate(kept.orderBy(F.desc("z"), "f").limit(features).collect())}
    model = OrdinalModel(vocabulary, np.zeros(len(vocabulary)), np.zeros(GRADES))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [words_of(t) for t in b.column("_text").to_pylist()]
            xs = [model.vector(bag) for bag in bags]
            told = [sum(n for w, n in bag.items() if any(f in vocabulary for f in word_features(w))) for bag in bags]
            yield pa.RecordBatch.from_pydict(
                {
                    "h": b.column("_h"),
                    "y": b.column("_y").cast(pa.int64()),
                    "told": told,
                    "j": [list(x) for x in xs],
                    "n": [list(x.values()) for x in xs],
                },
                schema=pa.schema(
                    [("h", pa.int64()), ("y", pa.int64()), ("told", pa.int64())]
                    + [("j", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]
                ),
            )

    got = sample.mapInArrow(vectors, "h long, y long, told long, j array<long>, n array<long>").collect()
    release(sample)
    got.sort(key=lambda r: r.h)
    told = np.array([r.told for r in got])
    toxic = np.array([r.y > 0 for r in got])
    cuts = np.quantile(told[toxic], [k / GRADES for k in range(1, GRADES)], method="higher")
    grades = np.where(toxic, 1 + np.searchsorted(cuts, told, side="left"), 0)
    rows = [{j: 1.0 + math.log(n) for j, n in zip(r.j, r.n)} for r in got]
    model.weights, model.thresholds = fit_cumulative_link(rows, grades, len(vocabulary), GRADES)
    return model


def severity(
    docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text: str = "text", keep_text: bool = False
) -> DataFrame:
    """``(id, expected_severity, grade, toxic)`` per row of ``docs``, with ``text`` and all other columns too if
    ``keep_text``; columns of the added names are replaced.

    Expected severity is the sum of P(grade >= k); the grade is the highest whose probability is at least ``DECISION``; a
    document of grade 1 or more is toxic. Null, empty and wordless texts have no features and count as clean unless
    most training texts are toxic. Repeated rows and rows without an id are scored like all others."""
    added = ["expected_severity", "grade", "toxic"]
    rest = [f for f in docs.schema.fields if f.name not in added] if keep_text else [docs.schema[id_col]]
    names = [f.name for f in rest]
    body = free_name("_text", docs.columns)
    schema = T.StructType(
        [*rest, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.IntegerType())]
        + [T.StructField(added[2], T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [model.at_least(t) for t in b.column(body).to_pylist()]
            grade = [int((x >= DECISION).sum()) for x in p]
            new = [pa.array([float(x.sum()) for x in p], pa.float64()), pa.array(grade, pa.int32())]
            new.append(pa.array([g > 0 for g in grade], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], schema.names)

    return docs.select(*names, F.col(text).alias(body)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``labels`` finds clean; all columns stay."""
    model = fit(docs, labels, id_col, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.at_least(t)[0] < DECISION for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
