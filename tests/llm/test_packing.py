import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def optimum(items, capacity):
    """Fewest bins by trying every placement."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                k = bins.index(room)
                go(i + 1, bins[:k] + [room - items[i]] + bins[k + 1 :])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def check(patterns, counts, capacity):
    held = defaultdict(int)
    for copies, content in patterns:
        assert copies > 0 and sum(x * c for x, c in content) <= capacity
        for x, c in content:
            held[x] += copies * c
    assert dict(held) == {x: n for x, n in counts.items() if n}
    return sum(copies for copies, _ in patterns)


@pytest.mark.parametrize("seed", range(25))
def test_few_pieces_are_packed_optimally(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 50, 100])
    items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 11))), reverse=True)
    counts = {x: items.count(x) for x in items}
    assert check(packing.fewest_sequences(counts, capacity), counts, capacity) == optimum(items, capacity)


@pytest.mark.parametrize("seed", range(4))
def test_many_pieces_come_near_the_bound(seed):
    rng = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(20000):
        counts[min(4096, int(rng.lognormvariate(6.5, 1)) + 1)] += 1
    total = sum(x * n for x, n in counts.items())
    got = check(packing.fewest_sequences(counts), counts, 4096)
    assert got <= sum(m for m, _ in packing.best_fit(counts, 4096))
    assert got <= -(-total // 4096) * 1.002 + 1


def test_worst_shapes():
    assert packing.fewest_sequences({}) == []
    for counts in ({4096: 10**9}, {2049: 5, 2047: 5}, {1: 10**7}, {1366: 9, 1365: 1, 2731: 2}):
        check(packing.fewest_sequences(counts), counts, 4096)
    assert check(packing.fewest_sequences({2049: 5, 2047: 5}), {2049: 5, 2047: 5}, 4096) == 5


def test_words_give_the_ids_of_whole_texts(spark):
    whole = Tokenizer.from_file(PATH)
    encoder = packing._Encoder(PATH)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "it's we'll 'S O'Re", "a\x1cb\x1fc", "x<|endoftext|>y", "\u00e9 \u0301a e\u0301x", "\u180ea b", "\u0130STANBUL \u03a3\u0391\u03a3"]
    texts += ["a\xa0b\u2003c\x85d", "z" * 5000, "\xbd\xb2x_1 \u200b", "\x7f\x80\xad9a", "\u6f22\u5b57 \U0001f600x", "".join(map(chr, range(33, 0x250)))]
    texts += ["".join(random.Random(i).choices("aB'stlL\xe9\xc9\xdf\u0149\u01c5 9\xb2\xaa\xba,.-", k=80)) for i in range(300)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_query_is_an_exact_packing(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = QUERIES["op4_bin_completion_packing"](spark, SF).collect()
    places = defaultdict(list)
    got = defaultdict(dict)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        cut = [(a, ids[a : a + 4096]) for a in range(0, len(ids), 4096)]
        want[d.doc_id] = {k: (a, len(x), zlib.crc32(x.tobytes())) for k, (a, x) in enumerate(cut)}
    assert dict(got) == want
    assert len(places) <= -(-sum(r.length for r in rows) // 4096) * 1.02 + 1


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "", 6), (2, "a b", 7), (2, "a b", 7), (3, "word " * 9000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = packing.pack_documents(df, PATH, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in out) == [(0, 0, 1), (1, 0, 1), (2, 0, 3), (2, 0, 3), (3, 0, 4096), (3, 1, 4096), (3, 2, 809)]
    assert all(len(r.ids) == 4 * r.length for r in out) and len({r.sequence_id for r in out}) == 3
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
