import random
import re

from plumbline.llm import decontam

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for item, text in items:
            x = words(text)
            size = min(len(x), 10)
            wins = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit.update(range(i, i + size))
                    named.add(item)
        out.append((d, len(w), len(hit), sorted(i for i in named if i is not None)))
    return out


def test_query_matches_sql(same_as_sql):
    assert same_as_sql("op8_prefix_decontamination", SF) > 0


def test_cases(spark):
    rng = random.Random(4)
    vocab = ["a", "B", "é", "É", "x1", "the", "Zé"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 7, 10, 11, 25])))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "..."), (43, items[5][1]), (44, items[5][1]), (None, items[6][1])]
    docs = [(i, ", ".join(rng.choices(vocab, k=rng.randrange(0, 60)))) for i in range(60)]
    docs += [(70 + i, "Xx " + (t or "") + "! yy") for i, t in items[:10]]
    docs += [(90, None), (91, ""), (None, items[3][1]), (92, items[3][1]), (92, items[3][1]), (93, "w " * 50000 + items[20][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, row string")
    got = decontam.decontaminate(d, b).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    want = brute(docs, items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got), key=key) == sorted(want, key=key)
    clean = sorted((str(x[0]), x[1] or "") for x, w in zip(docs, brute(docs, items)) if not w[2])
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == clean


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.decontaminate(d.limit(0), b).count() == 0
    row = decontam.decontaminate(d, b.limit(0)).first()
    assert (row.n_words, row.n_hit, row["items"]) == (3, 0, [])
    assert decontam.drop_contaminated(d, b.limit(0)).count() == 1 and decontam.drop_contaminated(d, b).count() == 0


def test_no_python_in_the_plan(spark):
    from plumbline.llm.queries import QUERIES

    plan = QUERIES["op8_prefix_decontamination"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
