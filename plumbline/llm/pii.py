"""Personal data: fixed patterns, and a skip-chain conditional random field that finds their other spellings.

Mentions are the spans of four fixed patterns, whose labels are given, and other pieces of text that look like
numbers, addresses or names of mailboxes. Neighbouring mentions form the chain. Skip edges tie a mention to the
one before with the same digits or address, to the first pattern span with the same ones, and to a pattern
span that ends in the same digits or has the same mailbox name, however far away; all edges of a kind share one
potential. Loopy sum-product messages give each open mention a label. A mention has at most four edges, so work
grows with the text, not with the square of a repeated token.

No table holds the labels of other spellings, so the potentials are fitted on texts of a bounded sample to
which other spellings of their own pattern spans, and lookalikes of foreign ones, are added.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from random import Random
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone"]
LABELS = len(KINDS) + 1  # the last one is "none"
NONE = len(KINDS)
EMAIL, IP, CARD, PHONE = range(4)

#: Texts looked at for the fit, about that many by hash; of these only texts with pattern spans and at
#: most ``SAMPLE_MENTIONS`` mentions are used.
SAMPLE_TEXTS = 20_000
SAMPLE_MENTIONS = 200
#: Message rounds, and how much of the old message stays.
ROUNDS, DAMPING = 12, 0.3
#: A mention gets a label of at least this probability.
SURE = 0.5
#: Digits that a lookalike shares with a pattern span, and characters between neighbours.
TAIL, LONG_TAIL, NEAR = 7, 9, 40

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+(?:[\x20()./_\[\]-]{1,3}[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(
    r"(?:\x20?[\[(]at[\])]\x20?|@)(?P<domain>[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)*)", re.I
)
_DOT = re.compile(r"\x20?[\[(]dot[\])]\x20?", re.I)
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")

# Features of an open mention, and kinds of edges.
BIAS, NUMBER, ADDRESS, MAILBOX, SIZES, PLUS, SPLIT, BYTES, LUHN, BRACKETS, FULL = 0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 15
FEATURES = 16
CHAIN, SAME, LONG_SUFFIX, SUFFIX, SAME_NAME = range(5)
EDGES = 5


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def _byte(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by kind and start, in one pass of each over the whole text."""
    out: list[tuple[int, int, int]] = []
    if not _ANY.search(text):
        return out
    after = 0
    for m in _DOMAIN.finditer(text):
        floor = max(after, text.rfind("@", after, m.start()) + 1)
        before = text[floor : m.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            out.append((EMAIL, m.start() - local, m.end()))
        after = m.end() if local else m.start() + 1
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = [(p.start(), p.end(), p.group()) for p in _DIGITS.finditer(text, m.start(), m.end())]
        for i in range(0, len(parts) - 3, 4):
            if all(_byte(p) for _, _, p in parts[i : i + 4]):
                out.append((IP, parts[i][0], parts[i + 3][1]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = "".join(_DIGITS.findall(m.group()))
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((PHONE, *m.span()))
    return out


class Mentions(NamedTuple):
    """Mentions of one text by start: spans, given labels (-1: open), features, and edges ``(a, b, kind)``."""

    spans: list[tuple[int, int]]
    given: list[int]
    features: list[list[int]]
    edges: list[tuple[int, int, int]]


def _number_features(digits: str, piece: str, groups: list[str]) -> list[int]:
    size = [9, 10, 11, 13, 20]
    out = [BIAS, NUMBER, SIZES + bisect_right(size, len(digits))]
    if piece.startswith(("+", "(+")):
        out.append(PLUS)
    if len(groups) > 1:
        out.append(SPLIT)
    if len(groups) == 4 and all(map(_byte, groups)):
        out.append(BYTES)
    if 13 <= len(digits) <= 19 and luhn(digits):
        out.append(LUHN)
    return out


class _Known:
    """The pattern spans of a text by what other spellings share with them; the first one counts."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]) -> None:
        self.whole: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.names: dict[str, int] = {}
        for i, (kind, s, e) in enumerate(spans):
            piece = text[s:e].lower()
            self.whole.setdefault(_key(kind, piece), i)
            if kind == EMAIL:
                name = piece.partition("@")[0]
                if len(name) >= 5 and re.search("[0-9]", name) and re.search("[a-z]", name):
                    self.names.setdefault(name, i)
            elif kind != IP:
                digits = "".join(_DIGITS.findall(piece))
                for n in range(TAIL, len(digits) + 1):
                    self.tails.setdefault(digits[-n:], i)


def _key(kind: int, piece: str) -> str:
    if kind == EMAIL:
        return piece
    return ("." if kind == IP else "").join(_DIGITS.findall(piece))


def _numbers(text: str, lo: int, hi: int, known: _Known) -> Iterator[tuple[int, int, list[str]]]:
    """Pieces of digit groups: those that spell a known number stand alone, the rest stays together."""
    for m in _NUMBER.finditer(text, lo, hi):
        groups = [(g.start(), g.end(), g.group()) for g in _DIGITS.finditer(text, *m.span())]
        rest: list[tuple[int, int, str]] = []
        i = 0
        while i < len(groups):
            stop, joined = -1, ""
            for j in range(i, len(groups)):
                joined += groups[j][2]
                if len(joined) > 19:
                    break
                if joined in known.tails:
                    stop = j
            if ".".join(g[2] for g in groups[i : i + 4]) in known.whole:
                stop = max(stop, min(i + 3, len(groups) - 1))
            if stop < 0:
                rest.append(groups[i])
                i += 1
                continue
            if rest:
                yield rest[0][0], rest[-1][1], [g[2] for g in rest]
                rest = []
            yield groups[i][0], groups[stop][1], [g[2] for g in groups[i : stop + 1]]
            i = stop + 1
        if rest:
            yield rest[0][0], rest[-1][1], [g[2] for g in rest]


def mentions(text: str) -> Mentions | None:
    """The mentions of a text and their edges; None where there is nothing to label."""
    base = base_spans(text)
    known = _Known(text, base)
    covered: list[list[int]] = []
    for _, s, e in sorted(base, key=lambda b: b[1:]):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    gaps = list(zip([0, *(e for _, e in covered)], [*(s for s, _ in covered), len(text)]))
    found: list[tuple[int, int, list[int], str, list[tuple[int, int]]]] = []  # span, features, key, ties to base
    for lo, hi in gaps:
        taken: list[tuple[int, int]] = []
        if "@" in text[lo:hi] or "[" in text[lo:hi] or "(" in text[lo:hi]:
            floor = lo
            for m in _AT.finditer(text, lo, hi):
                before = text[max(floor, text.rfind("@", floor, m.start()) + 1) : m.start()]
                local = len(before) - len(before.rstrip(_LOCAL))
                floor = m.end() if local else floor
                if not local:
                    continue
                name, domain = text[m.start() - local : m.start()].lower(), _DOT.sub(".", m["domain"]).lower()
                features = [BIAS, ADDRESS, *[BRACKETS] * ("@" not in m.group()), *[FULL] * ("." in domain)]
                key = f"{name}@{domain}"
                ties = [(known.whole[key], SAME)] if key in known.whole else [(known.names[name], SAME_NAME)] if name in known.names else []
                taken.append((m.start() - local, m.end()))
                found.append((*taken[-1], features, key, ties))
        free = list(zip([lo, *(e for _, e in taken)], [*(s for s, _ in taken), hi]))
        for a, b in free:
            if known.names:
                for m in _NAME.finditer(text, a, b):
                    name = m.group().rstrip(".").lower()
                    if name in known.names:
                        span = (m.start(), m.start() + len(name))
                        found.append((*span, [BIAS, MAILBOX], name, [(known.names[name], SAME_NAME)]))
            for s, e, groups in _numbers(text, a, b, known):
                digits, dotted = "".join(groups), ".".join(groups)
                if len(digits) < TAIL and dotted not in known.whole:
                    continue
                while s > a and text[s - 1] in "+(" and text[s - 1 : s + 1] != "((":
                    s -= 1
                ties = []
                if dotted in known.whole and len(groups) == 4:
                    ties = [(known.whole[dotted], SAME)]
                elif digits in known.whole:
                    ties = [(known.whole[digits], SAME)]
                elif digits in known.tails:
                    ties = [(known.tails[digits], LONG_SUFFIX if len(digits) >= LONG_TAIL else SUFFIX)]
                elif len(digits) <= 24:
                    longer = [digits[-n:] for n in range(len(digits) - 1, LONG_TAIL - 1, -1)]
                    ties = next(([(known.whole[d], LONG_SUFFIX)] for d in longer if d in known.whole), [])
                found.append((s, e, _number_features(digits, text[s:e], groups), digits, ties))
    if not found:
        return None
    nodes = sorted([(s, e, k, [], "", i) for i, (k, s, e) in enumerate(base)] + [(s, e, -1, f, key, t) for s, e, f, key, t in found], key=lambda x: x[:3])
    at_base = {n[5]: i for i, n in enumerate(nodes) if n[2] >= 0}
    edges, last = [], {}
    for i, (s, _, given, _, key, ties) in enumerate(nodes):
        if i and (given < 0 or nodes[i - 1][2] < 0) and s - nodes[i - 1][1] <= NEAR:
            edges.append((i - 1, i, CHAIN))
        if given < 0:
            edges += [(at_base[b], i, kind) for b, kind in ties]
            if key in last:
                edges.append((last[key], i, SAME))
            last[key] = i
    return Mentions([n[:2] for n in nodes], [n[2] for n in nodes], [n[3] for n in nodes], edges)


# --- the field ---------------------------------------------------------------------------------


class Model(NamedTuple):
    unary: np.ndarray  # feature x label
    pairs: np.ndarray  # edge kind x label x label


class Graph(NamedTuple):
    """Mentions of many texts as arrays: ``owner`` and ``feature`` list the features of the nodes."""

    given: np.ndarray
    owner: np.ndarray
    feature: np.ndarray
    a: np.ndarray
    b: np.ndarray
    kind: np.ndarray


def graph(parts: list[Mentions]) -> Graph:
    given = np.array([g for p in parts for g in p.given], dtype=np.int64)
    flat = [f for p in parts for f in p.features]
    first = np.cumsum([0, *(len(p.given) for p in parts)])
    edges = np.array([(a + o, b + o, k) for p, o in zip(parts, first.tolist()) for a, b, k in p.edges], dtype=np.int64).reshape(-1, 3)
    return Graph(
        given,
        np.repeat(np.arange(len(flat)), [len(f) for f in flat]),
        np.array([x for f in flat for x in f], dtype=np.int64),
        *edges.T,
    )


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def marginals(g: Graph, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every node and label pair probabilities of every edge by loopy messages."""
    scores = np.zeros((len(g.given), LABELS))
    np.add.at(scores, g.owner, model.unary[g.feature])
    fixed = g.given >= 0
    scores[fixed] = -1e4
    scores[fixed, g.given[fixed]] = 0
    tables = model.pairs[g.kind]
    forth, back = np.zeros((len(g.a), LABELS)), np.zeros((len(g.a), LABELS))  # to b, to a
    belief = scores
    for _ in range(ROUNDS):
        to_b = _log_sum((belief[g.a] - back)[:, :, None] + tables, 1)
        to_a = _log_sum((belief[g.b] - forth)[:, None, :] + tables, 2)
        to_b -= _log_sum(to_b, 1)[:, None]
        to_a -= _log_sum(to_a, 1)[:, None]
        forth, back = DAMPING * forth + (1 - DAMPING) * to_b, DAMPING * back + (1 - DAMPING) * to_a
        belief = scores.copy()
        np.add.at(belief, g.b, forth)
        np.add.at(belief, g.a, back)
    nodes = np.exp(belief - _log_sum(belief, 1)[:, None])
    pairs = (belief[g.a] - back)[:, :, None] + (belief[g.b] - forth)[:, None, :] + tables
    pairs = np.exp(pairs - _log_sum(pairs.reshape(-1, LABELS**2), 1)[:, None, None])
    return nodes, pairs


def learn(g: Graph, labels: np.ndarray, steps: int = 300, penalty: float = 1e-4, rate: float = 0.3) -> Model:
    """Potentials of largest penalised likelihood; expectations come from the messages."""
    unary, pairs = np.zeros((FEATURES, LABELS)), np.zeros((EDGES, LABELS, LABELS))
    unary[BIAS, NONE] = 1.0
    if not (g.given < 0).any():
        return Model(unary * 10, pairs)  # nothing to learn from: nothing is added
    truth = np.eye(LABELS)[labels]
    seen_u, seen_p = np.full_like(unary, 1e-6), np.full_like(pairs, 1e-6)
    scale = (g.given < 0).sum()
    for _ in range(steps):
        nodes, both = marginals(g, Model(unary, pairs))
        step_u, step_p = -penalty * unary, -penalty * pairs
        np.add.at(step_u, g.feature, (truth - nodes)[g.owner] / scale)
        np.add.at(step_p, g.kind, (truth[g.a][:, :, None] * truth[g.b][:, None, :] - both) / scale)
        seen_u, seen_p = seen_u + step_u**2, seen_p + step_p**2
        unary, pairs = unary + rate * step_u / np.sqrt(seen_u), pairs + rate * step_p / np.sqrt(seen_p)
    return Model(unary, pairs)


# --- examples ----------------------------------------------------------------------------------


def _spelled(kind: int, piece: str, rng: Random) -> str:
    """Another spelling of a pattern span, one that the pattern does not match."""
    if kind == EMAIL:
        name, _, domain = piece.partition("@")
        at, dot = rng.choice([("[at]", "[dot]"), (" [at] ", "."), ("(at)", "(dot)"), (" (at) ", " (dot) ")])
        return rng.choice([name, name + at + domain.replace(".", dot), name + at + domain])
    digits = "".join(_DIGITS.findall(piece))
    if kind == IP:
        return rng.choice(["[.]", "-", " . "]).join(_DIGITS.findall(piece))
    if kind == CARD:
        return rng.choice([".", "/", "_", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = digits[-rng.choice([7, 10, 10, len(digits)]) :]
    head, tail = digits[:-7], digits[-7:]
    sep = rng.choice(["-", ".", " ", ""])
    return rng.choice(["(%s) " % head, head + sep] if head else [""]) + tail[:3] + sep + tail[3:]


def _foreign(piece: str, rng: Random) -> str:
    """Something of the same shape with other digits and letters."""
    swap = lambda c: rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz")
    keep = re.compile(r"\x20?[\[(](?:at|dot)[\])]\x20?|[^A-Za-z0-9]", re.I)
    out, at = [], 0
    for m in keep.finditer(piece):
        out += [swap(c) for c in piece[at : m.start()]] + [m.group()]
        at = m.end()
    return "".join(out + [swap(c) for c in piece[at:]])


def example(text: str) -> tuple[Mentions, list[int]] | None:
    """A text of the sample with other spellings and lookalikes behind it, and the labels of its mentions."""
    base = base_spans(text)
    if not base or len(base) > SAMPLE_MENTIONS:
        return None
    rng = Random(crc32(text.encode()))
    words = text.split()
    pieces = []
    for kind, s, e in base:
        for own in (True, False):
            piece = _spelled(kind, text[s:e], rng)
            pieces += [(piece if own else _foreign(piece, rng), own, kind)] * rng.choice([0, 1, 1, 1, 2, 4])
    rng.shuffle(pieces)
    parts, at, true = [text], len(text), {}
    for piece, own, kind in pieces:
        fill = " " + "".join(rng.choice(words) + " " for _ in range(rng.randrange(15)))
        parts += [fill, piece]
        if own:
            true[(at + len(fill), at + len(fill) + len(piece))] = kind
        at += len(fill) + len(piece)
    got = mentions("".join(parts))
    if got is None or len(got.given) > 8 * SAMPLE_MENTIONS:
        return None
    labels = []
    for (s, e), given in zip(got.spans, got.given):
        hits = [k for (a, b), k in true.items() if s < b and a < e]
        labels.append(given if given >= 0 else hits[0] if hits else NONE)
    return got, labels


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Potentials from about ``SAMPLE_TEXTS`` texts, chosen by hash; only labels, features and edges of their
    mentions reach the driver, and equal texts count once. Without pattern spans the model adds nothing."""
    share = min(1.0, SAMPLE_TEXTS / max(docs.count(), 1))
    hashed = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))
    some = hashed.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).where(F.col("t").rlike("[0-9@]"))
    ints = pa.list_(pa.int32())
    names = ["given", "labels", "sizes", "features", "edges"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, hashes = [], []
            for h, t in zip(batch["h"].to_pylist(), batch["t"].to_pylist()):
                if made := example(t):
                    kept.append(made)
                    hashes.append(h)
            columns = [
                [m.given for m, _ in kept], [y for _, y in kept], [[len(f) for f in m.features] for m, _ in kept],
                [[x for f in m.features for x in f] for m, _ in kept], [[x for e in m.edges for x in e] for m, _ in kept],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), *[pa.array(c, ints) for c in columns]], ["h", *names])

    schema = "h long, " + ", ".join(f"{c} array<int>" for c in names)
    rows = some.mapInArrow(work, schema).dropDuplicates(["h"]).collect()
    parts, labels = [], []
    for r in sorted(rows, key=lambda r: r["h"]):
        cuts = np.cumsum([0, *r["sizes"]]).tolist()
        features = [r["features"][a:b] for a, b in zip(cuts, cuts[1:])]
        triples = list(zip(*[iter(r["edges"])] * 3))
        parts.append(Mentions([], r["given"], features, triples))
        labels += r["labels"]
    return learn(graph(parts), np.array(labels, dtype=np.int64))


def added_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to the pattern spans of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    where, parts = [], []
    for i, t in enumerate(texts):
        if t and _ANY.search(t) and (got := mentions(t)):
            where.append(i)
            parts.append(got)
    if not parts:
        return out
    nodes, _ = marginals(graph(parts), model)
    at = 0
    for i, part in zip(where, parts):
        for (s, e), given, p in zip(part.spans, part.given, nodes[at : at + len(part.given)]):
            if given < 0 and p[:NONE].max() >= SURE:
                out[i].append((int(p[:NONE].argmax()), s, e))
        at += len(part.given)
    return out


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added``, arrays of ``kind``, ``start`` and ``end`` (code points, end exclusive)
    by kind as in ``KINDS``, then start.

    Base spans are those of the four patterns in the whole text; added ones are other mentions that the field
    labels with a probability of at least ``SURE``, and overlap no base span. Each row stands alone: repeated rows
    give equal spans, null and empty texts none, an empty table an empty result. A column of ``docs`` named
    like a new one is replaced; all others are kept, whatever their names."""
    new = ["base", "added"]
    kept = [c for c in docs.columns if c not in new]
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("start", "end")]]))
    schema = T.StructType([nested.schema["row"], *[T.StructField(c, span) for c in new]])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans(found: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(found)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch["text"].to_pylist()]
                base = pa.array([spans(base_spans(t)) for t in texts], kind)
                added = pa.array([spans(x) for x in added_spans(texts, model)], kind)
                yield pa.RecordBatch.from_arrays([batch["row"], base, added], ["row", *new])

    out = nested.mapInArrow(work, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *new)
