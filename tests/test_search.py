"""Searches, graphs and text jobs against slow versions."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cluster, graph, joins, pairs, text, vectors


def km(a, b):
    (la, lo), (lb, lp) = a, b
    x = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, x)))


@pytest.mark.parametrize("k,n_sites", [(1, 600), (4, 600), (5, 3)])
def test_nearest_sites_of_clustered_points(spark, k, n_sites):
    rng = random.Random(k)
    city = [(48.1 + rng.gauss(0, 0.01), 11.5 + rng.gauss(0, 0.01)) for _ in range(n_sites * 2 // 3)]
    spots = city + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n_sites - len(city))]
    spots[-1] = spots[-2]  # two sites at one place
    points = [(48.1 + rng.gauss(0, 0.01), 11.5 + rng.gauss(0, 0.01)) for _ in range(500)]
    points += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(100)] + [(90.0, 0.0), (-90.0, 7.0), (0.0, 180.0), (0.0, -180.0), points[0]]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(-1, None, 1.0)], "point_id int, lat double, lon double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(spots)] + [(-1, 1.0, None)], "site_id int, lat double, lon double")
    got = {(r.point_id, r["rank"]): (r.site_id, round(r.dist_km, 6)) for r in joins.nearest_k(p, s, k).collect()}
    want = {}
    for i, x in enumerate(points):
        for j, (d, site) in enumerate(sorted((km(x, y), n) for n, y in enumerate(spots))[:k], 1):
            want[i, j] = (site, round(d, 6))
    assert {a: v[1] for a, v in got.items()} == pytest.approx({a: v[1] for a, v in want.items()}, abs=1e-5)
    assert sum(got[a] == want[a] for a in want) >= 0.99 * len(want)  # equal distances may differ in the last bit
    if n_sites > 100:
        clean = [df.dropna().select(c, "lat", "lon") for df, c in ((p, "point_id"), (s, "site_id"))]
        compared = joins._near_pairs(*clean, k, "site_id").count()
        assert compared < len(points) * n_sites / 2


def sides(spark, rows):
    return spark.createDataFrame(rows, "id int, t string")


def test_containment_of_short_long_and_boilerplate_texts(spark):
    rng = random.Random(3)
    template = "this agreement is made between the parties and shall remain in force until it is terminated by "
    big = [(i, template + f"party {i} of {rng.randrange(10**9)}" + (" xyz" if i % 50 == 0 else "")) for i in range(600)]
    big += [(900, "a"), (901, "AB"), (902, "Übermaß"), (903, ""), (904, None), (905, "abcabcabc"), (906, "\U0001F600\U0001F600")]
    small = [(i, big[i][1][60:]) for i in range(0, 600, 7)] + [(700, "xyz"), (701, "a"), (702, "party 13 of"), (703, "ÜBER"), (704, ""), (705, None),
                                                               (706, "cab"), (707, template), (708, template), (709, "nowhere to be found at all"), (710, "\U0001F600")]
    got = {(r.a, r.b) for r in joins.contains_join(sides(spark, big).toDF("a", "t"), sides(spark, small).toDF("b", "t"), "a", "t", "b", "t").collect()}
    want = {(i, j) for (i, x), (j, y) in itertools.product(big, small) if x and y and (y.lower() in x.lower() or x.lower() in y.lower())}
    assert got == want
    keyed = lambda rows: sides(spark, rows).filter("length(t) > 0").select(F.unhex(F.md5(F.lower("t"))).alias("h"), F.lower("t").alias("t")).dropDuplicates(["h"])
    unique = [r for r in small if r[0] < 700]
    assert joins.meetings(keyed(big), keyed(unique)).count() <= 2 * len(unique)  # the shared template draws no pairs


def test_betweenness_does_not_depend_on_the_batch(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(a, b, float(rng.randrange(1, 4))) for a in range(12) for b in range(12) if a != b and rng.random() < 0.3], "src int, dst int, weight double")
    whole = {r.id: round(r.betweenness, 9) for r in graph.betweenness(edges).collect()}
    assert {r.id: round(r.betweenness, 9) for r in graph.betweenness(edges, batch=5).collect()} == whole


def test_communities_fold_planted_groups_of_cliques(spark):
    """Cliques of four in groups of four: single moves find the cliques, folding them the groups."""
    rows = []
    for group in range(4):
        nodes = [[group * 16 + c * 4 + i for i in range(4)] for c in range(4)]
        for clique in nodes:
            rows += [(a, b, 1.0) for a, b in itertools.combinations(clique, 2)]
        rows += [(a, b, 0.25) for x, y in itertools.combinations(nodes, 2) for a in x for b in y]
        rows.append((group * 16, (group + 1) % 4 * 16, 0.1))
    labels, q = graph.communities(spark.createDataFrame(rows, "src int, dst int, weight double"))
    found = {}
    for r in labels.collect():
        found.setdefault(r.community, set()).add(r.id // 16)
    assert len(found) == 4 and all(len(x) == 1 for x in found.values())
    assert q > 0.7


def test_correlations_over_many_small_tiles(spark):
    rng = random.Random(5)
    rows = [(e, t, rng.gauss(0, 1) + e * t % 3) for e in range(9) for t in range(60) if rng.random() < 0.6 and (e < 8 or t < 5)]
    df = spark.createDataFrame(rows, "e int, t int, v double")
    one, many = (cluster.corr_matrix(df, "e", "t", "v", 3, **kw) for kw in ({}, {"entities_per_block": 2, "instants_per_slab": 7}))
    key = lambda d: {(r.entity_a, r.entity_b): (r.n, round(r["corr"], 9)) for r in d.collect()}
    assert key(one) == key(many)
    a = {t: v for e, t, v in rows if e == 0}
    b = {t: v for e, t, v in rows if e == 1}
    x, y = zip(*[(a[t], b[t]) for t in a if t in b])
    mx, my = sum(x) / len(x), sum(y) / len(y)
    r = sum((p - mx) * (q - my) for p, q in zip(x, y)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
    assert key(one)[0, 1] == (len(x), round(r, 9))


def test_rouge_and_bleu_equal_slow_versions(spark):
    rng = random.Random(7)
    words = ["the", "cat", "3.5", "sat", "on,", "Über", "x_y", "!", "mat"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(25))), " ".join(rng.choices(words, k=rng.randrange(25)))) for i in range(200)]
    rows += [(200, None, "a"), (201, "a b c d e", "a b c d e"), (202, "", "")]
    df = spark.createDataFrame(rows, "id int, g string, a string")

    def rouge(g, a):
        x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (g, a))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        n = table[-1][-1]
        return 2 * n / (len(x) + len(y)) if n else 0.0

    def bleu(g, a):
        x, y = (re.findall(r"\d+[.,]\d+|\w+|[^\w\s]", t or "") for t in (g, a))
        logs = 0.0
        for n in range(1, 5):
            have, want = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (y, x))
            hit = sum((have & want).values())
            if not hit:
                return 0.0
            logs += math.log(hit / sum(have.values())) / 4
        return math.exp(logs + min(0.0, 1 - len(x) / len(y)))

    for r in pairs.bleu(pairs.rouge_l(df, "g", "a"), "g", "a").collect():
        assert r.rouge_l == pytest.approx(rouge(r.g, r.a), abs=1e-12)
        assert r.bleu == pytest.approx(bleu(r.g, r.a), abs=1e-12), (r.g, r.a)
    plan = pairs.bleu(df, "g", "a")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_personal_data_spans_equal_a_plain_scan_without_python(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "x.y@mail.example.org", "10.0.0.1", "4111 1111 1111 1111", "123-45-6789", "+1 (743) 555-3824", "word", "12", " ", "\n", "5-5", "@"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randrange(30)))) for i in range(150)] + [(150, ""), (151, None), (152, "123-45-6789123-45-6789"), (152, "123-45-6789123-45-6789")]
    df = spark.createDataFrame(rows, "id int, t string")
    out = text.scan_pii(df, "id", "t")
    want, cut = [], []
    for i, t in rows:
        spans = []
        for label, pattern in text.PII_PATTERNS.items():
            mine = []
            for m in re.finditer(pattern, t or ""):
                if mine and mine[-1][2] >= m.start():
                    mine[-1] = (label, mine[-1][1], m.end())
                else:
                    mine.append((label, m.start(), m.end()))
            spans += mine
        want += [(i, label, s, e, t[s:e], t[max(0, s - 40) : e + 40]) for label, s, e in spans]
        at, parts = 0, []
        for s, e, label in sorted((s, e, label) for label, s, e in spans):
            if s >= at:
                parts += [t[at:s], f"[REDACTED_{label}]"]
            at = max(at, e)
        cut.append((i, None if t is None else "".join(parts) + t[at:]))
    assert sorted(tuple(r) for r in out["spans"].collect()) == sorted(want)
    assert sorted(map(str, (tuple(r) for r in out["redacted"].collect()))) == sorted(map(str, cut))
    for frame in out.values():
        assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_sort_keys_put_two_before_ten_and_numbers_before_letters(spark):
    numbers = ["10", "2", "2.10", "2.9", "2.a", "a", "2.9.1", "B", "12345678901234567890", "٣"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    got = [r.n for r in df.orderBy(text.sort_key(F.col("n"))).collect()]
    assert got == ["2", "2.9", "2.9.1", "2.10", "2.a", "10", "12345678901234567890", "a", "B", "٣"]


def test_penalised_matches_need_no_full_scan(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "bad text" if i % 3 == 0 else "good") for i in range(120)]
    t = spark.createDataFrame(rows, "item int, v array<double>, text string")
    q = t.filter("item < 20").select(F.col("item").alias("q"), "v", F.array(F.lit("BAD")).alias("cx"))
    got = {(r.q, r["rank"]): (r.item, round(r.score, 9)) for r in vectors.match_with_penalty(q, t, 4, "v", "q", "item", -1.0, "cx", "text").collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for i, v, _ in rows[:20]:
        best = sorted(((-(cos(v, w) - (0.1 if "bad" in s else 0)), j) for j, w, s in rows))[:4]
        assert [got[i, n] for n in range(1, 5)] == [(j, round(-s, 9)) for s, j in best]
