"""Repeated word windows across documents by super-k-mer partitioning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.names import free_name
from plumbline.session import cut_lineage

#: Words of a minimiser: long enough that no common word or word pair draws a bucket to itself.
MINIMISER = 3
#: Text that a task turns into super-k-mers at once, and text per bucket.
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20
#: Rows without an id come after all others.
LAST = (1 << 63) - 1

_HEAD = np.dtype([("doc", "<i8"), ("hash", "<i8"), ("start", "<i4"), ("n", "<i4"), ("known", "u1")])
_SPANS = T.StructType(
    [
        T.StructField("_doc", T.LongType()),
        T.StructField("_hash", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
    ]
)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    held = np.empty(len(words), dtype=object)
    held[:] = words
    return pd.factorize(held)


def _window_minima(order: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = order, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _frozen(head: np.ndarray, strings: list[bytes]) -> bytes:
    """Heads by column, ids as steps (they rise within a chunk), then the strings."""
    docs = np.diff(head["doc"], prepend=np.int64(0))
    parts = [np.int64(len(head)).tobytes(), docs.tobytes()]
    return b"".join([*parts, *(head[c].tobytes() for c in _HEAD.names[1:]), b"\n".join(strings)])


def _thawed(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
    head = np.zeros(n, dtype=_HEAD)
    for c in _HEAD.names:
        head[c] = np.frombuffer(raw, _HEAD[c], n, at)
        at += n * _HEAD[c].itemsize
    head["doc"] = np.cumsum(head["doc"])
    return head, raw[at:].split(b"\n")


def _packed(texts: list[str], docs: np.ndarray, hashes: np.ndarray, window: int, buckets: int):
    """Yield ``(bucket, blob)`` with the super-k-mers of these texts, which come in order of ``docs``.

    A string already seen in a smaller document is known to repeat: only its place travels, and as that is settled,
    not to the bucket of its minimiser but to one of ``buckets`` further ones, spread by document."""
    split = [t.encode().split() for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    words = [w for s in split for w in s]
    if len(words) < window:
        return
    codes, uniques = _codes(words)
    order = np.array([xxhash.xxh64_intdigest(u) for u in uniques], dtype=np.uint64)[codes]
    grams = order[: len(order) - MINIMISER + 1].copy()
    for k in range(1, MINIMISER):
        grams = _mixed(grams) + order[k : k + len(grams)]
    minima = _window_minima(_mixed(grams), window - MINIMISER + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    first = ends - sizes
    at = np.arange(len(minima))
    valid = at + window <= ends[owner[: len(minima)]]
    new = np.ones(len(minima), dtype=bool)
    new[1:] = (minima[1:] != minima[:-1]) | (owner[1 : len(minima)] != owner[: len(minima) - 1]) | ~valid[:-1]
    starts = at[new & valid]
    # A run ends before the next start or the first window that leaves its document.
    stops = np.minimum(np.append(starts[1:], len(minima)), ends[owner[starts]] - window + 1)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    offset = np.concatenate([[0], np.cumsum(lens + 1)])
    buffer = b" ".join(words)
    lo, hi = offset[starts].tolist(), (offset[stops + window - 1] - 1).tolist()
    whose = owner[starts]
    head = np.zeros(len(starts), dtype=_HEAD)
    head["doc"], head["hash"] = docs[whose], hashes[whose]
    head["start"], head["n"] = starts - first[whose], stops - starts
    seen: dict[bytes, int] = {}
    strings: list[bytes] = []
    known = np.zeros(len(starts), dtype=np.uint8)
    ids = head["doc"].tolist()
    for i, (a, b) in enumerate(zip(lo, hi)):
        s = buffer[a:b]
        if seen.setdefault(s, ids[i]) < ids[i]:
            known[i] = 1
            s = b""
        strings.append(s)
    head["known"] = known
    bucket = (_mixed(minima[starts]) % np.uint64(buckets)).astype(np.int64)
    if known.any():  # the smallest of these documents names one bucket for all that is settled here
        bucket[known == 1] = buckets + zlib.crc32(head["doc"][:1].tobytes()) % buckets
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    press = zstandard.ZstdCompressor(level=3)
    for part in np.split(by, cuts):
        if len(part):
            yield int(bucket[part[0]]), press.compress(_frozen(head[part], [strings[i] for i in part]))


def _repeats(blobs: list[bytes], window: int) -> np.ndarray:
    """Spans of windows of one bucket that also start in a smaller document, as ``_HEAD`` rows."""
    heads, strings = [], []
    open_ = zstandard.ZstdDecompressor()
    for blob in blobs:
        more, texts = _thawed(open_.decompress(blob))
        heads.append(more)
        strings += texts
    head = np.concatenate(heads)
    fresh = head["known"] == 0
    done = head[~fresh]
    head = head[fresh]
    words = b" ".join([s for s, f in zip(strings, fresh.tolist()) if f]).split()
    if not words:
        return done
    codes = _codes(words)[0]
    n = head["n"].astype(np.int64)
    size = n + window - 1
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(head)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + step
    mixed = _mixed(codes.astype(np.uint64) + np.uint64(1))
    rolled = np.zeros(len(codes) - window + 1, dtype=np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x100000001B3) + mixed[k : k + len(rolled)]
    key, doc = _mixed(rolled)[at], head["doc"][row]
    by = np.lexsort((doc, key))
    new = np.ones(len(by), dtype=bool)
    new[1:] = key[by][1:] != key[by][:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    # Equal hashes are compared word by word with the first of their group.
    rest = np.flatnonzero(lead != np.arange(len(by)))
    wrong = np.zeros(len(rest), dtype=bool)
    for k in range(window):
        wrong |= codes[at[by[rest]] + k] != codes[at[by[lead[rest]]] + k]
    if wrong.any():  # two different windows of one hash: name the windows exactly instead
        exact = np.stack([codes[at + k] for k in range(window)], axis=1)
        key = np.unique(exact, axis=0, return_inverse=True)[1].reshape(-1)
        by = np.lexsort((doc, key))
        new[1:] = key[by][1:] != key[by][:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = np.zeros(len(by), dtype=bool)
    again[by] = doc[by] > doc[by][lead]
    hit = np.flatnonzero(again)
    if not len(hit):
        return done
    broken = np.ones(len(hit), dtype=bool)
    broken[1:] = (np.diff(hit) != 1) | (row[hit][1:] != row[hit][:-1])
    starts = np.flatnonzero(broken)
    out = head[row[hit[starts]]].copy()
    out["start"] += step[hit[starts]].astype(np.int32)
    out["n"] = np.diff(np.append(starts, len(hit)))
    return np.concatenate([done, out])


def _keys(id_col: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))]


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = 13,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``(_doc, _hash, start, n)``: ``n`` windows from word ``start`` on whose words also start in a smaller document.

    ``_doc`` is the id (rows without one count as the largest) and ``_hash`` the hash of the text, so rows that
    share an id are told apart. Consecutive windows of one minimiser travel as one string, compressed with the
    other strings of their task and bucket; strings that repeat within ``BATCH_BYTES`` of a task are settled there, so a
    passage that very many documents share reaches its bucket once per such batch, and what is settled is spread over
    buckets of its own. The number of buckets follows the text."""
    doc, mark = _keys(id_col, text)
    keyed = docs.select(doc.alias("_doc"), mark.alias("_hash"), F.col(text).alias("_text"))
    total = keyed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            hashed = b.column(1).to_numpy(zero_copy_only=False)
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            by = np.argsort(doc, kind="stable")
            parts = max(1, round(int(size.sum()) / BATCH_BYTES))
            group = (np.cumsum(size[by]) - size[by]) * parts // max(1, int(size.sum()))
            for held in np.split(by, np.flatnonzero(np.diff(group)) + 1):
                texts = [t or "" for t in b.column(2).take(pa.array(held)).to_pylist()]
                rows = list(_packed(texts, doc[held], hashed[held], window, buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    ["bucket", "blob"],
                )

    def settle(group: pa.Table) -> pa.Table:
        got = _repeats(group.column("blob").to_pylist(), window)
        cols = [pa.array(np.ascontiguousarray(got[c])) for c in ("doc", "hash", "start", "n")]
        return pa.table(cols, names=["_doc", "_hash", "start", "n"])

    packed = keyed.mapInArrow(pack, "bucket long, blob binary")
    return packed.groupBy("bucket").applyInArrow(settle, _SPANS)


def _kept(text: str, spans, window: int) -> tuple[bytes, list[bytes], np.ndarray]:
    raw = text.encode()
    words = raw.split()
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n in spans:
        gone[start] += 1
        gone[min(start + n + window - 1, len(words))] -= 1
    return raw, words, np.cumsum(gone[:-1]) > 0


def _cut_text(raw: bytes, gone: np.ndarray) -> str:
    """The text without the words marked in ``gone``; what is left of it is joined by line breaks."""
    runs: list[list[int]] = []
    before = True
    for m, out in zip(_WORD.finditer(raw), gone.tolist()):
        if not out:
            if before:
                runs.append([m.start(), m.end()])
            else:
                runs[-1][1] = m.end()
        before = out
    return b"\n".join(raw[a:b] for a, b in runs).decode()


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 13, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` with repeated words cut out of ``text`` and columns n_words, n_removed and kept_sha256 (of the kept
    words, joined by one space) added; existing columns of those names are replaced.

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller id. Windows
    are judged on the input. Untouched texts stay as they are, a null text stays null and has no words, rows with
    fewer words than a window stay whole, repeated rows of one id do not count against each other, rows without an id
    come last. No row is dropped; an empty table gives an empty result."""
    added = ["n_words", "n_removed", "kept_sha256"]
    rest = [f for f in docs.schema.fields if f.name not in (*added, text)]
    shape = docs.schema[text]
    names = [f.name for f in rest]
    spans = (
        cut_lineage(repeated_spans(docs, id_col, text, window, bucket_bytes))  # frees the packed strings' files
        .groupBy("_doc", "_hash")
        .agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("_spans"))
    )
    held = [free_name(n, docs.columns) for n in ("_doc", "_hash", "_spans", "_text", "_starts", "_lengths")]
    doc, mark, spans_of, body, starts_of, lengths_of = held
    spans = spans.select(F.col("_doc").alias(doc), F.col("_hash").alias(mark), F.col("_spans").alias(spans_of))
    joined = docs.withColumns(dict(zip((doc, mark), _keys(id_col, text)))).join(spans, [doc, mark], "left")
    schema = T.StructType(
        [
            *rest,
            T.StructField(text, shape.dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed, digests = [], [], [], []
            starts = b.column(starts_of).to_pylist()
            lengths = b.column(lengths_of).to_pylist()
            for t, s, n in zip(b.column(body).to_pylist(), starts, lengths):
                raw, words, gone = _kept(t or "", zip(s or (), n or ()), window)
                lost = int(gone.sum())
                kept = words if not lost else [w for w, g in zip(words, gone.tolist()) if not g]
                texts.append(_cut_text(raw, gone) if lost else t)
                counts.append(len(words))
                removed.append(lost)
                digests.append(sha256(b" ".join(kept)).hexdigest())
            new = [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            new.append(pa.array(digests, pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], [*names, text, *added])

    return joined.select(
        *names,
        F.col(text).alias(body),
        F.col(spans_of)["start"].alias(starts_of),
        F.col(spans_of)["n"].alias(lengths_of),
    ).mapInArrow(cut, schema)
