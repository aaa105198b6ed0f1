import random
from hashlib import sha256

import numpy as np

from plumbline.llm import substrings
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(docs, window=13):
    """(n_words, n_removed, digest) per document by comparing all windows; docs are (id, text)."""
    least = {}
    split = [(LAST if d is None else d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), sha256(kept).hexdigest()))
    return out


LAST = substrings.LAST


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d, *b) for (d, _), b in zip(docs, brute(docs)))
    assert sorted(tuple(r) for r in QUERIES["op9_superkmer_substrings"](spark, SF).collect()) == want


def test_small_buckets_and_batches(spark, monkeypatch):
    rng = random.Random(1)
    passage = [f"w{rng.randrange(30)}" for _ in range(60)]
    docs = []
    for d in range(80):
        words = [f"w{rng.randrange(4)}" for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(words) + 1)
        a = rng.randrange(30)
        words[at:at] = passage[a : a + rng.randrange(10, 30)]
        docs.append((d // 2 if d < 20 else d, rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(None, " ".join(passage)), (None, " ".join(passage)), (500, None), (501, ""), (502, " ".join(passage))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(df, bucket_bytes=256).collect()
    want = sorted(((d, *b) for (d, _), b in zip(docs, brute(docs))), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want


def test_text_keeps_untouched_parts(spark):
    same = " ".join(f"x{i}" for i in range(13))
    rows = [(1, same, 7), (2, f"a\n b  {same}\n\nc  d", 8), (3, " kept \n as it is ", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert out[1].text == same and out[3].text == " kept \n as it is "
    assert out[2].text == "a\n b\nc  d" and (out[2].n_words, out[2].n_removed) == (17, 13)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_long_text_and_hash_clash(spark, monkeypatch):
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")
    out = {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert out == {1: 0, 2: 60000}
    words = [" ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20)), " ".join(f"a{i}" for i in range(20))]
    docs = np.array([1, 2, 3])
    plain = [b for _, b in substrings._packed(words[:1], docs[:1], docs[:1], 13, 1)]
    plain += [b for _, b in substrings._packed(words[1:], docs[1:], docs[1:], 13, 1)]
    monkeypatch.setattr(substrings, "_mixed", lambda x: np.zeros_like(x))
    got = substrings._repeats(plain, 13)
    assert {int(r["doc"]) for r in got} == {3} and int(got["n"].sum()) == 8
