import random

import numpy as np

import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.components import connected_components
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(parts))


def groups(prints, distance):
    """Smallest reachable id by plain search over all pairs."""
    low = dict(enumerate(range(len(prints))))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if low[j] < low[i] and (a ^ b).bit_count() <= distance:
                    low[i], changed = low[j], True
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[low[i]] = min(d, least.get(low[i], d))
    return [least.get(low[i]) for i in range(len(prints))]


def alike(docs):
    """Smallest id reachable over pairs of texts that share four fifths of their five-word shingles."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    low = list(range(len(docs)))
    changed = True
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return [min(d for (d, _), m in zip(docs, low) if m == mine) for mine in low]


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs.sort()
    prints = [(d, slow_print(t)) for d, t in docs]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(prints, groups(prints, 2))}
    assert {tuple(r) for r in QUERIES["op6_simhash_pigeonring"](spark, SF).collect()} == want


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("dense", [2, 1000])
def test_links_keep_every_component(spark, distance, dense):
    rng = random.Random(distance)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(8):
            prints.add(f)
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                f ^= 1 << rng.randrange(64)
    rows = [(i, f) for i, f in enumerate(sorted(prints))]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    df = spark.createDataFrame(signed, "i long, fingerprint long")
    edges = simhash.links(df, distance, dense)
    by = {r.node: r.root for r in connected_components(edges).collect()}
    got = {}
    for i, f in signed:
        got.setdefault(by.get(f, f), []).append(i)
    want = {}
    for (i, _), c in zip(rows, groups(rows, distance)):
        want.setdefault(c, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_odd_rows(spark):
    long = "word " * 70000 + "end"
    rows = [(3, None, 1), (2, "", 2), (None, "a b c d", 3), (7, "a b c d", 4), (7, "a b c d", 4), (9, long, 5), (8, long, 6), (5, " \t", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    out = simhash.near_duplicates(df)
    got = sorted((r.doc_id, r.component_id) for r in out.where("doc_id is not null").collect())
    assert got == [(2, 2), (3, 2), (5, 2), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert out.where("doc_id is null").first().component_id == 7
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [2, 8])
def test_similar_groups_match_brute_force(spark, dense):
    rng = random.Random(dense)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([6, 60, 300]))]
        for _ in range(20):
            docs.append(" ".join(base))
            if rng.random() < 0.7:
                base[rng.randrange(len(base))] = rng.choice(words)
    docs += [None, "", " ", "one two", "One TWO", "one two three"]
    rng.shuffle(docs)
    rows = [(i, t, "x") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, dense=dense).collect()}
    assert got == dict(enumerate(alike([r[:2] for r in rows])))
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values())) and {r.node for r in kept} == {"x"}


def test_similar_texts_with_fingerprints_far_apart(spark):
    """Four of five shingles are common, but the fingerprints differ in 25 bits."""
    docs = []
    for i in (1707, 2094, 3676):
        short = " ".join(f"{c}{i}" for c in "abcdefgh")
        docs += [short, f"{short} i{i}"]
        a, b = (simhash._majority(simhash._hashes(t, 5, 42)) for t in docs[-2:])
        assert ((a ^ b) & (2**64 - 1)).bit_count() == 25
    got = simhash.similar_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_pairs_inside_a_template_family(spark):
    """Strangers share 225 of 271 shingles (0.71), planted pairs 241 (0.80): hot keys, and one pair per group."""
    page = " ".join(f"t{i}" for i in range(229))
    own = lambda name, k: " ".join(f"{name}x{i}" for i in range(k))
    docs = [f"{page} {own(f'p{p}', 16)} {own(f'q{p}s{side}', 30)}" for p in range(300) for side in range(2)]
    docs += [f"{page} {own(f'r{i}', 46)}" for i in range(1500)]
    rows = list(enumerate(docs))
    random.Random(1).shuffle(rows)
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {i: i - i % 2 if i < 600 else i for i, _ in rows}
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_fingerprint_column_agrees_with_spark_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("the quick fox")).alias("h")).first()
    assert simhash.fingerprint("The quick FOX") == row.h


def test_families_inside_one_key_meet_by_their_differences(spark):
    """Three templates and strangers to all, in one key: every similar pair of two roots is found or linked."""
    rng = random.Random(4)
    nodes, sets = [], {}
    for f in range(3):
        page = [rng.getrandbits(64) for _ in range(rng.choice([40, 90]))]
        for _ in range(50):
            own = set(page)
            for _ in range(rng.randrange(14)):
                own.discard(rng.choice(page))
                own.add(rng.getrandbits(64))
            nodes.append(own)
            if rng.random() < 0.3:  # shares some changes with the one before
                near = set(own)
                for _ in range(rng.randrange(1, 8)):
                    near.discard(rng.choice(sorted(near)))
                    near.add(rng.getrandbits(64))
                nodes.append(near)
    nodes += [{rng.getrandbits(64) for _ in range(30)} for _ in range(20)]
    for i, x in enumerate(nodes):
        sets[i] = x
    raw = lambda x: np.array(sorted(x), dtype="<u8").view("<i8").tolist()
    name = lambda i: bytearray(f"n{i:04d}".encode())
    table = spark.createDataFrame([(name(i), raw(x)) for i, x in sets.items()], "node binary, hs array<long>")
    members = spark.createDataFrame([(t, 7, name(i), name(i)) for i in sets for t in (0, 1)], "tag int, key long, node binary, root binary")
    linked, candidates = simhash._apart(members, table, 0.8)
    number = lambda b: int(bytes(b)[1:])
    links = {(number(r.a), number(r.b)) for r in linked.collect()}
    found = {(number(r.a), number(r.b)) for r in candidates.collect()}
    alike = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert links <= alike and len(alike) > 200
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links | (found & alike):
        root[max(top(i), top(j))] = min(top(i), top(j))
    assert all(top(i) == top(j) for i, j in alike)
    assert len(found) < 3 * len(alike) < len(sets) ** 2 / 8


@pytest.mark.parametrize("size", [3000])
def test_a_large_family_draws_few_candidates(spark, size):
    """All share a page of 120 shingles and have 45 of their own (0.57 alike): no pair is drawn."""
    rng = np.random.default_rng(1)
    page = rng.integers(1, 1 << 63, 120, dtype=np.uint64)
    rows = [(f"n{i:05d}".encode(), np.unique(np.concatenate([np.delete(page, rng.integers(0, 120, 10)), rng.integers(1, 1 << 63, 40, dtype=np.uint64)])).view("<i8").tolist()) for i in range(size)]
    table = spark.createDataFrame([(bytearray(n), r) for n, r in rows], "node binary, hs array<long>")
    members = table.selectExpr("0 as tag", "1L as key", "node", "node as root")
    linked, candidates = simhash._apart(members, table, 0.8)
    assert linked.count() == 0 and candidates.count() < size


def test_groups_take_the_operators_links_through_the_exact_check(spark, monkeypatch):
    """What ``near_duplicates`` groups is one group if its shingles are similar, with or without a common band."""
    rng = random.Random(5)
    while True:
        text = " ".join(f"{rng.getrandbits(40):x}" for _ in range(8))
        if not set(simhash._sketch(text, 5)[1]) & set(simhash._sketch(f"{text} z", 5)[1]):
            break
    df = spark.createDataFrame([(0, text), (1, f"{text} z"), (2, "one two three"), (3, "four five six")], "doc_id long, text string")
    real = simhash.near_duplicates
    asked = []

    def grouped(docs, id_col="doc_id", *args, **kw):
        out = real(docs, id_col, *args, **kw)
        asked.append(id_col)
        node = {r.text: r[id_col] for r in docs.collect()}
        pairs = [(node[text], node[f"{text} z"]), (node["one two three"], node["four five six"])]
        low = spark.createDataFrame([(m, min(p)) for p in pairs for m in p], "m binary, low binary")
        return out.join(low, out[id_col] == low["m"]).select(id_col, "fingerprint", F.col("low").alias("component_id"))

    monkeypatch.setattr(simhash, "near_duplicates", grouped)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 2, 3]
    assert asked == ["node"]


def test_groups_settle_components_once(spark, monkeypatch):
    """Long chains are one group each; only the operator and the end run component rounds."""
    rng = random.Random(3)
    docs = []
    for g in range(3):
        base = [f"g{g}w{rng.getrandbits(30)}" for _ in range(200)]
        for _ in range(80):
            docs.append(" ".join(base))
            base[rng.randrange(len(base))] = f"g{g}w{rng.getrandbits(30)}"
    rng.shuffle(docs)
    real, runs = simhash.connected_components, []

    def counted(edges):
        runs.append(1)
        return real(edges)

    monkeypatch.setattr(simhash, "connected_components", counted)
    rows = list(enumerate(docs))
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(alike(rows)))
    assert len(runs) == 2
