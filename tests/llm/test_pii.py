import itertools
import random
import re
from hashlib import sha256

import numpy as np
import pytest

from plumbline.llm import pii
from plumbline.llm.queries import QUERIES

# The four patterns as they are stated.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_patterns_equal_the_plain_ones():
    rng = random.Random(2)
    bits = ["@", ".", "+", "-", " ", "(", ")", "a", "b.c", "1", "23", "255", "256", "1.2.3.4", "x@y.z", "a@b", "+1 (743) 555-3824",
            "4381893557741609", "4111 1111 1111 1111", "é", "\n", "%_", "0001", "12345678"]
    for _ in range(30000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert pii.base_spans(t) == plain(t), t


@pytest.mark.parametrize("t", ["a" * 300000, "1" * 300000, "1." * 150000, "@" * 200000, "a@" * 100000, "+1" + " " * 200000, "((" * 100000 + "1",
                               "1 " * 150000, "a(at)" * 60000, "+1 (743) 555-3824 " + "5553824 " * 40000])
def test_long_odd_texts_take_linear_time(t):
    model = pii.Model(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.EDGES, pii.LABELS, pii.LABELS)))
    assert len(pii.added_spans([t], model)) == 1


def test_messages_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(4)
    for edges, exact in [([(0, 1, 0), (1, 2, 1), (1, 3, 2)], 1e-2), ([(0, 1, 0), (1, 2, 1), (0, 2, 1), (2, 3, 3)], 0.08)]:
        features = [[0, 1], [0, 4], [0], [0, 2]]
        g = pii.graph([pii.Mentions([(i, i) for i in range(4)], [-1, -1, -1, 3], features, edges)])
        model = pii.Model(0.5 * rng.normal(size=(pii.FEATURES, pii.LABELS)), 0.5 * rng.normal(size=(pii.EDGES, pii.LABELS, pii.LABELS)))
        want = np.zeros((4, pii.LABELS))
        for y in itertools.product(range(pii.LABELS), repeat=4):
            if y[3] != 3:
                continue
            s = sum(model.unary[f, y[i]] for i in range(3) for f in features[i])
            s += sum(model.pairs[k, y[a], y[b]] for a, b, k in edges)
            for i in range(4):
                want[i, y[i]] += np.exp(s)
        want /= want.sum(axis=1, keepdims=True)
        assert np.abs(pii.marginals(g, model)[0] - want).max() < exact


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_other_spellings_are_found_and_strangers_left_alone(model):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    hit = missed = wrong = clean = 0
    for i in range(400):
        digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        phone = f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"
        mail = f"{word()}.{digits(2)}@{word()}.com"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        d = re.sub("[^0-9]", "", phone)[1:]
        name, domain = mail.split("@")
        other, kind, base = [
            (f"{d[:3]}-{d[3:6]}-{d[6:]}", 3, phone), (f"{d[:3]}.{d[3:6]}.{d[6:]}", 3, phone), ("1" + d, 3, phone),
            (f"{name} [at] {domain.replace('.', ' [dot] ')}", 0, mail), (name, 0, mail), (ip.replace(".", "[.]"), 1, ip),
        ][i % 6]
        stranger = [f"{digits(3)}-{digits(3)}-{digits(4)}", digits(11), f"{digits(4)} {digits(6)}", f"{digits(5)}/{digits(7)}"][i % 4]
        fill = [word() for _ in range(60)]
        text = " ".join(fill[:20] + [base] + fill[20:40] + [other] + fill[40:50] + [stranger] + fill[50:])
        at = text.index(other, text.index(base) + len(base))
        got, alone = pii.added_spans([text, text.replace(base, "x")], model)
        found = any(k == kind and s <= at and e >= at + len(other) for k, s, e in got)
        hit, missed = hit + found, missed + (not found)
        there = text.index(stranger, at)
        wrong += any(s < there + len(stranger) and e > there for _, s, e in got)
        clean += bool(alone)
    assert hit / (hit + missed) > 0.97 and wrong <= 4 and clean == 0, (hit, missed, wrong, clean)


def test_consistent_labels_across_a_document(model):
    text = "call +1 (743) 555-3824 now " + " ".join(f"word{'a' * (i % 5)} 743 555 3824" for i in range(300))
    (got,) = pii.added_spans([text], model)
    assert len(got) == 300 and {k for k, _, _ in got} == {3}


def test_rows_of_all_kinds(spark, model):
    t = "mail a.b1@c.de here"
    rows = [(1, t, "x"), (1, t, "x"), (None, None, None), (2, "", "y"), (3, "no data", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string").selectExpr("*", "base as row", "base as `a.b`")
    got = pii.find(docs, model).orderBy("doc_id").collect()
    assert [(r.doc_id, [tuple(x) for x in r.base], list(r.added), r.row, r["a.b"]) for r in got] == [
        (None, [], [], None, None), (1, [("email", 5, 14)], [], "x", "x"), (1, [("email", 5, 14)], [], "x", "x"), (2, [], [], "y", "y"), (3, [], [], "z", "z"),
    ]
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_holds_the_plain_spans(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_skip_chain_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        names = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(names) <= set(spans)
        order = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in spans)]
        assert order == sorted(order)
        if not want:
            assert not spans
