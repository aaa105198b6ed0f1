import random
from hashlib import sha256
from zlib import crc32

import pytest

from plumbline.llm import runs
from plumbline.llm.queries import QUERIES


def slow(words):
    """Every stretch by every period, smallest period first."""
    n, seen = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                seen.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, length, p) for (s, length), p in seen.items())


def kept(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rng, n):
    """Words of few kinds with repeated stretches, repeats inside repeats among them."""
    out = []
    while len(out) < n:
        block = [f"w{rng.randrange(rng.choice([2, 3, 40]))}" for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 40]))]
        if rng.random() < 0.3:
            block = block * rng.choice([2, 4, 5]) + [f"x{rng.randrange(3)}"]
        times = rng.choice([1, 1, 2, 3, 4, 5, 6])
        out += (block * times)[: len(block) * times - rng.randrange(len(block))] or block
    return out


def test_equal_to_every_period_tried():
    rng = random.Random(5)
    texts = [random_text(rng, rng.choice([0, 1, 5, 6, 7, 30, 100, 400, 900])) for _ in range(150)]
    many = 0
    for words, (n, found, collapsed) in zip(texts, runs.find_in_texts([" ".join(w) for w in texts])):
        assert n == len(words)
        assert found == slow(words)
        assert collapsed == kept(words, found)
        many += sum(p >= runs.DIRECT for _, _, p in found)
    assert many > 50  # the scales did find some


def test_deep_nesting_and_one_word_texts_stay_fast():
    block = ["a"]
    for i in range(5):
        block = block * 6 + [f"b{i}"]
    texts = ["a " * 200000, " ".join(block), " ".join(["a", "b"] * 60000 + ["c"] + ["a", "b"] * 60000)]
    (n, found, collapsed), (_, deep, _), (_, halves, _) = runs.find_in_texts(texts)
    assert (n, found, collapsed) == (200000, [(0, 200000, 1)], "a")
    assert {p for _, _, p in deep} == {1, 7, 43, 259, 1555}
    assert halves == [(0, 120000, 2), (120001, 120000, 2)]


def test_rows_of_all_kinds(spark):
    rows = [(1, "a a a a a a", "x"), (1, "a a a a a a", "x"), (None, None, None), (2, "", "y"), (3, " \t\n\x0b\x0c\r ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "row")
    got = runs.find_runs(docs.withColumn("n_words", docs.row)).orderBy("doc_id", "text").collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.row) for r in got] == [
        (None, 0, [], "", None), (1, 6, [(0, 6, 1)], "a", "x"), (1, 6, [(0, 6, 1)], "a", "x"), (2, 0, [], "", "y"), (3, 0, [], "", "z"),
    ]
    assert runs.find_runs(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_minimizer_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), crc32(str(doc_id).encode())
        g = h // 10
        planted = h % 10 == 0 and n > 0
        if planted:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500 and not planted:
            continue
        r, found = got[doc_id], slow(words)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        assert r.n_runs == len(found)
        assert r.runs_sha256 == sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(kept(words, found).encode()).hexdigest()
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == top
        assert r.exponent_milli == (1000 * top[1] // top[2] if found else None)


def test_query_equals_sql(same_as_sql):
    assert same_as_sql("op11_minimizer_runs", "/root/testdata/sf0.01") == 1000
