"""Packing token pieces into sequences by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Steps looked at for one sequence and fillings kept for branching in the first search, how often both grow, and
#: sequences (or runs of equal ones) placed in all searches together.
FILL_NODES, BRANCHES, WIDEN, SEARCH_NODES = 400, 4, 4, 12_000
#: Words whose ids a worker remembers at least, twice as many at most, and the longest such word.
WORDS_HELD, WORD_CHARS = 400000, 64
#: Texts that must be encoded whole: white space on which Python and the tokenizer differ, special tokens.
_WHOLE = re.compile("[\x1c-\x1f\u180e]|<\\|")
# Fixed values of the tokenizer: how it parts a word, and its names for bytes.
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_PARTS = re.compile(_SUFFIXES + r"|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PARTS = regex.compile(_SUFFIXES + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters whose lower case is one letter whatever stands beside them.
_LATIN = re.compile("[\x21-\u012f\u0131-\u024f]+")
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_NAMES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}

Pattern = tuple[int, tuple[tuple[int, int], ...]]


class _Words(dict):
    """Token ids by word, as little-endian 32-bit bytes; unknown words are looked up part by part.

    The tokenizer lower-cases, parts letters, digits and signs, and then merges inside each part alone. Words of the
    Latin blocks are parted here and only new parts reach its merge model; other words go through it whole. A part
    is a word with the same ids, so both are held together. When the table is full it becomes the older one, whose
    words come back as they are met again."""

    def __init__(self, tokenizer):
        super().__init__()
        self.whole, self.merge = tokenizer, tokenizer.model.tokenize
        self.ids = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.older: dict[str, bytes] = {}

    def _merged(self, part: str) -> bytes:
        named = part if part.isascii() else "".join([_BYTE_NAMES[b] for b in part.encode()])
        ids = self.ids
        return b"".join([ids[t.id] for t in self.merge(named)])

    def _parted(self, word: str) -> bytes:
        if word.isascii():
            low, rule = word.lower(), _ASCII_PARTS
        elif _LATIN.fullmatch(word):
            low, rule = unicodedata.normalize("NFC", word).lower(), _PARTS
        else:
            return encoded(self.whole, word)
        if low.isalpha():  # letters alone are one part
            return self._merged(low) if low == word else self[low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return self[low[:-1]] + self[low[-1]]
        parts = rule.findall(low)
        return self._merged(low) if parts == [word] else b"".join([self[p] for p in parts])

    def __missing__(self, word: str) -> bytes:
        raw = self.older.get(word)
        if raw is None:
            raw = self._parted(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS_HELD:
                self.older = dict(self)
                self.clear()
            self[word] = raw
        return raw


def encoded(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class _Encoder:
    """Token ids of texts. The tokenizer never joins what white space parts, so ids are kept by word."""

    held: dict[str, _Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)

    @classmethod
    def of(cls, path: str) -> _Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if _WHOLE.search(text):
            return encoded(self.tokenizer, text)
        return b"".join(map(self.words.__getitem__, text.split()))


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: id, piece, start, length, ids_crc32 (and ids with ``with_ids``).

    Every document is its ids and one end id, so a null or empty text is a piece of one token. Only documents longer
    than the capacity are cut. ``part`` and ``nth`` say which task made the piece and how many pieces of its length
    came before it there."""
    kind = docs.schema[id_col].dataType
    extra = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType(
        [T.StructField(id_col, kind)]
        + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()))]
        + [T.StructField(n, T.LongType()) for n in ("ids_crc32", "part", "nth")]
        + extra
    )
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(tokenizer)
        task = TaskContext.get().partitionId()
        made: dict[int, int] = {}
        for b in batches:
            source, rows, raw = [], [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                ids = encoder.encode(t or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    nth = made.get(n, 0)
                    made[n] = nth + 1
                    source.append(i)
                    rows.append((k, at // 4, n, zlib.crc32(part), task, nth))
                    if with_ids:
                        raw.append(part)
            cols = np.array(rows, dtype=np.int64).reshape(-1, 6)
            arrays = [b.column(id_col).take(pa.array(source, pa.int64())), pa.array(cols[:, 0].astype(np.int32))]
            arrays += [pa.array(np.ascontiguousarray(cols[:, c])) for c in range(1, 6)]
            arrays += [pa.array(raw, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(id_col, F.col(text).alias("_text")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal sequences are filled together."""
    open_: dict[int, list[list]] = {}  # room -> [[copies, contents]]
    rooms: list[int] = []

    def put(copies: int, content: tuple, room: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append([copies, content])

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                each = min(n, capacity // x)
                copies = n // each
                put(copies, ((x, each),), capacity - each * x)
                n -= copies * each
                continue
            room = rooms[at]
            copies, content = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // x, n)
            took = min(copies, n // each)
            if took < copies:
                put(copies - took, content, room)
            put(took, (*content, (x, each)), room - each * x)
            n -= took * each
    return [(copies, content) for group in open_.values() for copies, content in group]


def _fillings(free: list[int], counts: dict[int, int], room: int, nodes: int, keep: int) -> tuple[list[tuple[int, tuple]], int, bool]:
    """Up to ``keep`` undominated fillings of ``room`` as (waste, contents), least waste first, large pieces first, the
    steps it took, and whether these are all there are.

    A filling is dominated if one of its pieces could make way for a longer unused one."""
    found: dict[tuple, int] = {}
    used: dict[int, int] = {}
    spent = 0
    perfect = 0

    def leaf(left: int) -> None:
        nonlocal perfect
        for x in used:
            if used[x]:
                at = bisect_right(free, x)
                while at < len(free) and free[at] <= x + left:
                    if counts[free[at]] > used.get(free[at], 0):
                        return
                    at += 1
        content = tuple((x, c) for x, c in sorted(used.items(), reverse=True) if c)
        if content not in found:
            found[content] = left
            perfect += left == 0

    def grow(left: int, upto: int) -> None:
        nonlocal spent
        spent += 1
        at = bisect_right(free, left, 0, upto) - 1
        last = True
        while at >= 0 and spent <= nodes and perfect < keep:
            x = free[at]
            if counts[x] > used.get(x, 0):
                last = False
                used[x] = used.get(x, 0) + 1
                rest = left - x
                exact = rest and rest <= x and counts.get(rest, 0) > used.get(rest, 0)
                if exact:
                    used[rest] = used.get(rest, 0) + 1
                    leaf(0)
                    used[rest] -= 1
                elif rest == 0:
                    leaf(0)
                else:
                    grow(rest, at + 1)
                used[x] -= 1
            at -= 1
        if last:
            leaf(left)

    grow(room, len(free))
    if not found:  # the limit struck before any filling was whole: take the longest pieces that fit
        left, content = room, {}
        at = bisect_right(free, left) - 1
        while at >= 0:
            x = free[at]
            c = min(left // x, counts[x])
            if c:
                content[x], left = c, left - c * x
            at = min(at, bisect_right(free, left)) - 1
        found[tuple(content.items())] = left
    best = sorted(((w, c) for c, w in found.items()), key=lambda f: (f[0], [(-x, -n) for x, n in f[1]]))
    return best[:keep], spent, spent <= nodes and perfect < keep and len(best) <= keep


def fewest_sequences(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[Pattern]:
    """Patterns ``(copies, ((length, count), ...))`` that hold all pieces of a histogram in few sequences.

    Branch and bound by bin completion: the longest piece left gets undominated fillings in turn, least waste
    first; a branch ends when its waste leaves no way to beat the incumbent, which starts as best-fit decreasing.
    A first search places each filling as often as its pieces last. Further ones place it once at a time, among
    more and more fillings of a sequence, until the lower bound is met, a search has left out no undominated filling
    (then its result is the least possible), or ``nodes`` placements are spent, ``FILL_NODES`` steps over fillings
    counting as one; the best found is returned."""
    counts = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    bound = max(-(-total // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))
    best = best_fit(counts, capacity)
    fill, keep, runs = FILL_NODES, BRANCHES, True
    while sum(m for m, _ in best) > bound and nodes > 0:
        best, spent, whole = _search(dict(counts), capacity, total, bound, best, nodes, fill, keep, runs)
        if whole and not runs:
            break
        nodes -= spent
        if not runs:
            fill, keep = fill * WIDEN, keep * WIDEN
        runs = False
    return best


def _search(
    counts: dict[int, int], capacity: int, total: int, bound: int, best: list[Pattern], nodes: int, fill: int, keep: int, runs: bool
) -> tuple[list[Pattern], int, bool]:
    """One search: the best patterns known after it, the placements it took, and whether no filling was left out."""
    size = sum(m for m, _ in best)
    free = sorted(counts)
    placed: list[Pattern] = []
    stack: list[tuple[Iterator, int]] = []
    waste = bins = spent = steps = 0
    whole = True

    def change(pattern: Pattern, sign: int) -> None:
        for x, c in pattern[1]:
            was = counts.get(x, 0)
            counts[x] = was + sign * c * pattern[0]
            if sign < 0 and not counts[x]:
                free.pop(bisect_left(free, x))
            elif sign > 0 and not was:
                free.insert(bisect_left(free, x), x)

    def branch() -> Iterator[tuple[int, Pattern]]:
        nonlocal whole, steps
        x = free[-1]
        counts[x] -= 1
        spare = free if counts[x] else free[:-1]
        options, tried, all_of_them = _fillings(spare, counts, capacity - x, fill, keep)
        whole, steps = whole & all_of_them, steps + tried
        counts[x] += 1
        for lost, content in options:
            held = dict(content)
            held[x] = held.get(x, 0) + 1
            copies = min(counts[y] // c for y, c in held.items()) if runs else 1
            yield lost * copies, (copies, tuple(sorted(held.items(), reverse=True)))

    if free:
        stack.append((branch(), 0))
    while stack and size > bound:
        if spent + steps // FILL_NODES >= nodes:
            return best, nodes, False
        options, _ = stack[-1]
        step = next(options, None)
        if step is None:
            stack.pop()
            if placed and stack:
                done = placed.pop()
                change(done, 1)
                bins -= done[0]
                waste -= stack[-1][1]
            continue
        lost, pattern = step
        if waste + lost > (size - 1) * capacity - total:
            continue
        spent += 1
        change(pattern, -1)
        placed.append(pattern)
        stack[-1] = (options, lost)
        waste += lost
        bins += pattern[0]
        if free:
            stack.append((branch(), 0))
        else:
            if bins < size:
                best, size = list(placed), bins
            placed.pop()
            change(pattern, 1)
            bins -= pattern[0]
            waste -= lost
    return best, spent + steps // FILL_NODES + 1, whole


def _layout(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by their number within the length: blocks sorted by (length, first number)."""
    rows, numbered, base = [], {}, 0
    for copies, content in patterns:
        offset = 0
        for x, c in content:
            first = numbered.get(x, 0)
            rows.append((x, first, c, base, offset))
            numbered[x] = first + c * copies
            offset += x * c
        base += copies
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {n: np.ascontiguousarray(table[:, i]) for i, n in enumerate(("length", "first", "count", "base", "offset"))}


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> DataFrame:
    """``pieces`` (of ``token_pieces``) with ``sequence_id`` and ``offset``; offsets of a sequence have no gap.

    The driver sees one count per length, so at most ``capacity`` of them whatever the corpus, and packs those.
    Pieces of one length are numbered by task and place in the task, and a piece's number says its sequence."""
    pieces = cut_lineage(pieces)
    per_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    plan = _layout(fewest_sequences(counts, capacity, nodes))
    step = np.int64(max(counts.values(), default=0) + 1)
    if (capacity + 1) * int(step) >= 1 << 63:
        raise OverflowError("too many pieces of one length")
    edges = plan["length"] * step + plan["first"]
    rest = [f for f in pieces.schema.fields if f.name not in ("part", "nth")]
    schema = T.StructType([*rest, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            number = b.column("_number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, length * step + number, side="right") - 1
            inside = number - plan["first"][at]
            copy, slot = inside // plan["count"][at], inside % plan["count"][at]
            new = [pa.array(plan["base"][at] + copy), pa.array(plan["offset"][at] + slot * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), *new], schema.names)

    numbered = pieces.join(offsets, ["length", "part"]).select(
        *[f.name for f in rest], (F.col("nth") + F.col("_before")).alias("_number")
    )
    return numbered.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Every document's pieces with their sequence and place: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one. Repeated rows and rows without an id are packed like all others. Other columns of
    ``docs`` are left out, whatever their names. An empty table gives an empty result."""
    return pack(token_pieces(docs, tokenizer, id_col, text, capacity, with_ids), capacity)
