"""SimHash near-duplicates: pigeonring candidate filter, full Hamming check, components.

``near_duplicates`` links fingerprints at a stated number of bits; ``similar_groups`` links texts at a stated share of
common shingles: what ``near_duplicates`` finds is checked and joined first, MinHash bands give the other candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.llm.components import connected_components
from plumbline.llm.names import free_name
from plumbline.session import cut_lineage, release

BITS = 64
#: Shingles whose bits are counted at once, which bounds the memory of a very long text.
CHUNK = 1 << 16


def _hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; nothing for a wordless one."""
    words = (text or "").encode().lower().split()
    if len(words) <= shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = (b" ".join(p) for p in zip(*(words[i:] for i in range(shingle))))
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed long."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK]
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included, as a signed long.

    A-Z are lower-cased, words end at ASCII white space. A text of fewer words than ``shingle`` has its
    whole word sequence as its one shingle; null and wordless texts have fingerprint zero."""
    return _majority(_hashes(text, shingle, seed))


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` without its text but with the fingerprint, in one Arrow pass without a shuffle."""
    rest = [f for f in docs.schema.fields if f.name not in (text, name)]
    body = free_name("_text", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([fingerprint(t, shingle) for t in b.column(body).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(r.name) for r in rest), f], [*(r.name for r in rest), name])

    schema = T.StructType([*rest, T.StructField(name, T.LongType())])
    return docs.select(*[r.name for r in rest], F.col(text).alias(body)).mapInArrow(run, schema)


def _segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``distance + 1`` segments around the ring of bits."""
    n = distance + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(spans: list[tuple[int, int]]) -> int:
    m = sum(((1 << w) - 1) << s for s, w in spans)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def _ring_keys(distance: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(start segment, bits that must be equal) of each candidate key.

    With ``distance + 1`` segments some chain start has an equal first segment (budget below one), and the
    second segment on its chain then differs in at most one bit, so one of its halves is equal too."""
    seg = _segments(distance)
    keys = []
    for i in range(len(seg)):
        s, w = seg[(i + 1) % len(seg)]
        for half in ((s, w // 2), (s + w // 2, w - w // 2)):
            keys.append((i, [seg[i], half]))
    return keys


def _chain_holds(diff: Column, start: int, distance: int) -> Column:
    """Cumulative differences along the chain stay within their proportional budgets."""
    seg = _segments(distance)
    ok = F.lit(True)
    for length in range(1, len(seg) + 1):
        spans = [seg[(start + k) % len(seg)] for k in range(length)]
        budget = length * distance // len(seg)
        ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_mask(spans)))) <= budget)
    return ok


def links(prints: DataFrame, distance: int = 2, dense: int = 32, name: str = "fingerprint") -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints within ``distance`` bits (0 to 2).

    Every fingerprint gets the keys of ``_ring_keys``. Of a key with at most ``dense`` members, the pairs
    that pass the chain budgets and the Hamming check are linked. In a key with more members, each member is
    linked to the smallest member that shares a ball centre (itself or one flipped free bit) with it: two words
    share a centre just if they differ in at most two bits, and a centre has at most 65 members, so a dense
    cluster costs rows in proportion to its size and loses no connection."""
    if not 0 <= distance <= 2:
        raise ValueError("distance is 0, 1 or 2")
    a = F.col(name).alias("fp")
    if distance == 0:
        return prints.select(a, a.alias("b")).where(F.lit(False)).toDF("a", "b")
    keys = _ring_keys(distance)
    distinct = prints.select(a).where("fp is not null").distinct()
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("tag"), F.col("fp").bitwiseAND(F.lit(_mask(spans))).alias("key"))
                    for t, (_, spans) in enumerate(keys)
                ]
            )
        ).alias("k"),
    ).select("fp", "k.tag", "k.key")
    shared = keyed.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = cut_lineage(keyed.join(shared, ["tag", "key"]))

    few = live.where(F.col("n") <= dense)
    x, y = few.alias("x"), few.alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    chain = None
    for t, (start, _) in enumerate(keys):
        ok = _chain_holds(diff, start, distance)
        chain = F.when(F.col("x.tag") == t, ok) if chain is None else chain.when(F.col("x.tag") == t, ok)
    near = (F.col("x.fp") < F.col("y.fp")) & chain & (F.bit_count(diff) <= distance)
    same_key = (F.col("x.tag") == F.col("y.tag")) & (F.col("x.key") == F.col("y.key"))
    pairs = x.join(y, same_key & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    many = live.where(F.col("n") > dense)
    centres = None
    for t, (_, spans) in enumerate(keys):
        free = [_mask([(i, 1)]) for i in range(BITS) if not any(s <= i < s + w for s, w in spans)]
        flips = F.array(F.lit(0).cast("long"), *[F.lit(m) for m in free])
        centres = F.when(F.col("tag") == t, flips) if centres is None else centres.when(F.col("tag") == t, flips)
    balls = many.select("tag", "fp", F.explode(centres).alias("flip")).withColumn(
        "centre", F.col("fp").bitwiseXOR(F.col("flip"))
    )
    around = W.partitionBy("tag", "centre")
    low = F.min("fp").over(around)
    if distance == 1:  # two words one flip from a centre that is no member differ in two bits
        low = F.when(F.max(F.col("flip") == 0).over(around), F.col("centre"))
    stars = balls.withColumn("low", low).where("low <> fp").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return pairs.union(stars)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    distance: int = 2,
    dense: int = 32,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row of ``docs``; fingerprints link at ``distance`` or fewer bits.

    The component id is the smallest id reachable over links, the row's own included. Equal fingerprints are
    collapsed before any pairing. Rows with a null id belong to their component too, whose id is null only if
    all its ids are. Repeated rows are kept. An empty table gives an empty result. Columns named in ``carry``
    are kept."""
    prints = cut_lineage(with_fingerprint(docs.select(id_col, text, *carry), text, shingle))
    classes = prints.groupBy("fingerprint").agg(F.min(id_col).alias("_low"))
    roots = connected_components(links(prints, distance, dense))
    whole = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("_root"), "_low"
    )
    lows = whole.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = whole.join(lows, "_root").select(F.col("fingerprint").alias("_fp"), "component_id")
    return prints.join(named, F.col("fingerprint") == F.col("_fp")).select(
        id_col, "fingerprint", "component_id", *carry
    )


#: Minima of permuted shingle hashes make ``BANDS`` keys of ``ROWS`` minima each. Texts of similarity 0.8 share
#: a key with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, above 0.9998.
BANDS, ROWS = 12, 3
#: Leaders that all members of a key are compared with first, and leaders of families tried per key before what is
#: still far from all of them is joined without one.
ROUNDS, LEADERS = 2, 3
#: Pairs of two groups that are compared at once, in turn; one that is similar settles the others.
WAVES = (1, 16, None)
#: Longs of a set's parity signature.
WORDS = 4
_ODD = np.random.default_rng(6).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _sketch(text: str | None, shingle: int) -> tuple[int, list[int]]:
    """Number of distinct shingles, and the keys of the text."""
    h = np.unique(_hashes(text, shingle, 42))
    if not len(h):
        return 0, [0] * BANDS
    low = np.empty(len(_ODD), dtype="<u8")
    for i, m in enumerate(_ODD):
        x = h * m
        low[i] = (x ^ (x >> np.uint64(32))).min()
    keys = [xxhash.xxh64_intdigest(b.tobytes()) for b in low.reshape(BANDS, ROWS)]
    return len(h), [k - (1 << 64) if k >> 63 else k for k in keys]


def _parity(hashes: str) -> Column:
    """Signature of a set: each hash flips one bit of ``WORDS`` longs, so two sets differ in at least as many hashes
    as their signatures differ in bits."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def word(i: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", one, F.pmod(x, F.lit(64)).cast("int"))
        mine = lambda x: F.pmod(F.shiftright(x, 6), F.lit(WORDS)) == i
        return F.aggregate(hashes, zero, lambda acc, x: acc.bitwiseXOR(F.when(mine(x), bit(x)).otherwise(zero)))

    return F.array(*[word(i) for i in range(WORDS)])


def _may_be_similar(x: str, y: str, similarity: float) -> Column:
    """False only where the signatures ``sig`` of two sets of ``n`` hashes show a similarity below ``similarity``."""
    bits = sum((F.bit_count(F.col(f"{x}.sig")[i].bitwiseXOR(F.col(f"{y}.sig")[i])) for i in range(WORDS)), F.lit(0))
    return bits <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of distinct ``pairs(a, b)`` those whose distinct shingles have a Jaccard similarity of ``similarity`` or more."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("s")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hs").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    alike = common * (1 + similarity) >= (F.size("s") + F.size("t")) * similarity - 1e-9
    return both.where(alike).select("a", "b")


def _differences(family: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``family(leader, node, root)`` with the numbers of shingles ``n`` and ``nl``, ``linked`` (similar to the
    leader), ``near`` (distance of at most a half) and the shingles in which node and leader differ, ``els``, which
    are left empty beyond a distance that no partner of a near node has. A null leader has no shingles."""
    spread = 1 - similarity
    none = F.array().cast("array<long>")
    lead = sets.select(F.col("node").alias("leader"), F.col("hs").alias("ls"))
    joined = family.join(sets.select("node", "hs"), "node").join(lead, "leader", "left")
    sides = joined.withColumn("ls", F.coalesce("ls", none))
    apart = F.concat(F.array_except("hs", "ls"), F.array_except("ls", "hs"))
    sized = sides.select("leader", "node", "root", _parity("hs").alias("sig"), F.size("hs").alias("n"), F.size("ls").alias("nl"), apart.alias("all"))
    d = F.size("all")
    far = 2 * d / F.greatest(F.col("n") + F.col("nl") + d, F.lit(1))  # the distance: differing over all shingles
    led = F.col("nl") > 0
    whole = ~led | (far <= 0.5 + spread + 1e-9)
    return cut_lineage(
        sized.select(
            "leader", "node", "root", "sig", "n", "nl", d.alias("d"), (led & (far <= spread + 1e-12)).alias("linked"),
            (far <= 0.5).alias("near"), F.when(whole, F.col("all")).otherwise(none).alias("els"),
        )
    )


def _family_pairs(diff: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of two roots in a leader's family of one ``turn``, among them all of ``similarity`` or more but
    those of two linked nodes.

    Two sets differ in d + e - 2c shingles if they differ from their leader in d and e, c of them in common. What
    makes strangers of a template alike is no part of these differences, and a node that is not linked to the
    leader must share some with every similar one: more the farther both are. So a prefix-filtered join over the differences,
    rarest first by their counts in the family, meets hardly any strangers. With no leader the differences are
    the whole sets, and this is the plain prefix filter."""
    part = (1 - similarity) / (1 + similarity)  # similar sets differ in at most this share of their sizes' sum
    long = diff.where(F.size("els") > 0).select("turn", "leader", "node", "root", "sig", "n", "nl", "d", "linked", F.explode("els").alias("h"))
    counts = long.groupBy("turn", "leader", "h").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = long.join(counts.where("lo <> hi").select(F.col("turn").alias("_t"), F.col("leader").alias("_l"), F.col("h").alias("_h"), "c"),
                       F.col("leader").eqNullSafe(F.col("_l")) & (F.col("h") == F.col("_h")) & (F.col("turn") == F.col("_t"))).drop("_t", "_l", "_h")
    mine = W.partitionBy("turn", "leader", "node")
    rank = F.row_number().over(mine.orderBy("c", "h")) - 1
    # Differences that no other root has come first.
    placed = shared.withColumn("pos", rank + F.col("d") - F.count(F.lit(1)).over(mine))
    n, nl, d = F.col("n"), F.col("nl"), F.col("d")
    alone = similarity * n  # without a leader the partner is at least as large, or has this share of the size
    apart = F.when(nl == 0, alone).otherwise((d + (nl - n) * part) / 2)  # common with any unlinked partner, at least
    touch = (d - (n + nl) * part) / 2  # of an unlinked node with a linked partner, at least
    early = F.col("pos") < d - F.ceil(apart - 1e-6) + 1
    late = ~F.col("linked") & (nl > 0) & (F.col("pos") < d - F.greatest(F.ceil(touch - 1e-6), F.lit(1)) + 1)
    keys = cut_lineage(placed.select("turn", "leader", "node", "root", "sig", "n", "d", "linked", "h", "pos", early.alias("early"), late.alias("late")).where("early or late"))
    x, y = keys.alias("x"), keys.alias("y")
    needed = (F.col("x.d") + F.col("y.d") - (F.col("x.n") + F.col("y.n")) * part) / 2 - 1e-6
    ok = F.col("x.leader").eqNullSafe(F.col("y.leader")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.turn") == F.col("y.turn"))
    ok &= F.col("x.root") != F.col("y.root")
    ok &= (~F.col("x.linked") & ~F.col("y.linked") & F.col("x.early") & F.col("y.early") & (F.col("x.node") < F.col("y.node"))) | (
        F.col("x.late") & F.col("y.linked") & F.col("y.early")
    )
    ok &= F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6
    ok &= _may_be_similar("x", "y", similarity)
    ok &= F.least(F.col("x.d") - F.col("x.pos"), F.col("y.d") - F.col("y.pos")) >= needed
    a, b = F.col("x.node"), F.col("y.node")
    pairs = cut_lineage(x.join(y, ok).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    release(keys)
    return pairs


def _apart(members: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """For ``members(tag, key, node, root)`` the similar pairs with a leader, and candidates among which all other
    similar pairs of two roots are that share a key; what the former join is one root for the latter.

    Each key takes a leader; nodes at a distance of at most a half from it meet in its family, where nodes a little
    farther take part too, since two similar nodes' distances differ by no more than their own. Nodes beyond a half go
    on to the key's next leader, and after ``LEADERS`` of them into one join without a leader."""
    links, left, diffs = None, members, []
    for turn in range(LEADERS + 1):
        first = F.min_by("node", F.struct(F.xxhash64("node", F.lit(turn)), "node"))
        lead = F.when(F.lit(turn < LEADERS), first).alias("leader")
        keys = left.groupBy("tag", "key").agg(lead, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        keys = keys.select("tag", "key", "leader")
        placed = cut_lineage(left.join(keys, ["tag", "key"]))
        if turn:
            release(left)
        if placed.isEmpty():
            release(placed)
            break
        diff = _differences(placed.select("leader", "node", "root").distinct(), sets, similarity)
        diffs.append(diff)
        close = diff.where("linked and node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        links = close if links is None else links.union(close)
        far = diff.where("not near").select("leader", "node")
        left = cut_lineage(placed.join(far, ["leader", "node"], "left_semi").select("tag", "key", "node", "root"))
        release(placed)
    if links is None:
        none = members.select(F.col("node").alias("a"), F.col("node").alias("b")).where(F.lit(False))
        return none, none
    links = cut_lineage(links.distinct())
    roots = _merged(members.select("node", "root").distinct(), links)
    every = reduce(DataFrame.union, [diff.drop("root").withColumn("turn", F.lit(turn)) for turn, diff in enumerate(diffs)])
    out = _family_pairs(every.join(roots, "node"), similarity)
    release(roots, *diffs)
    return links, out


def _two_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs(a, b)`` that lie in two groups, with the smaller and the larger root ``ra`` and ``rb``."""
    x = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
    y = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where("x <> y")
    return both.select("a", "b", F.least("x", "y").alias("ra"), F.greatest("x", "y").alias("rb"))


def _contracted(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots(node, root)`` after the ends of ``edges(a, b)`` are joined."""
    between = _two_roots(edges, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    moved = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    after = cut_lineage(roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")))
    release(roots)
    return after


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots(node, root)`` with each root replaced by the smallest one within two of ``edges(a, b)``.

    This joins a star whole and a longer chain in part, in a few shuffles: equal roots are connected, unequal ones may
    be. It saves comparisons between rounds; groups are settled once at the end, by ``_contracted`` over all edges."""
    one_way = cut_lineage(_two_roots(edges, roots).select("ra", "rb").distinct())
    both = one_way.union(one_way.select("rb", "ra")).toDF("x", "y")
    low = both.groupBy(F.col("x").alias("y")).agg(F.min(F.least("x", "y")).alias("m"))
    moved = both.join(low, "y").groupBy(F.col("x").alias("root")).agg(F.min("m").alias("_to"))
    after = cut_lineage(roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")))
    release(roots, one_way)
    return after


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    dense: int = 8,
) -> DataFrame:
    """``(id, node, component_id)`` per row of ``docs``: groups of texts with a shingle similarity of 0.8 or more.

    ``node`` is the digest of the text: equal texts are one node before any pairing. ``near_duplicates`` groups the
    fingerprints within two bits by the pigeonring; each node of such a group whose shingles are similar to those of
    the group's smallest is joined with it, the others are not. At this similarity fingerprints may differ in some ten
    of 64 bits and more, where no bits are a selective key and no number of bits is a bound, so the other candidates
    share a key of hash minima. They pass a bound on their numbers of shingles, and then the same exact comparison.
    First each node is compared with the leader of its largest key, then ``ROUNDS`` times with a leader of each other
    group that it shares a key with, and what is linked is one group from then on.
    Then members that are still apart are compared: all pairs of a key with at most ``dense`` of them, and in larger
    ones the pairs that ``_apart`` finds by their differences from leaders, a few per pair of groups at a time, as one similar
    pair joins two groups. So every pair of the similarity that shares a key lies in one group, in a key of any size.

    Null and wordless texts are one group. Rows with a null id take part; a group's id is null only if
    all its ids are. Repeated rows stay, an empty table gives an empty result."""
    node = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("node")
    plain = docs.select(F.col(id_col).alias("id"), node, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_sketch(t, shingle) for t in b.column("text").to_pylist()]
            cols = [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("node"), *cols], ["id", "node", "n", "keys"])

    kinds = [plain.schema["id"], plain.schema["node"]]
    kinds += [T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    rows = cut_lineage(plain.mapInArrow(run, T.StructType(kinds)))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("keys").alias("keys")))
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("tag", "key"))
    shared = keyed.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    live = cut_lineage(keyed.join(shared, ["tag", "key"]))
    close = near_duplicates(plain.select("node", "text"), "node").where("node <> component_id")
    close = cut_lineage(close.select(F.col("component_id").alias("a"), F.col("node").alias("b")).distinct())
    ends = live.select("node").union(close.select("a")).union(close.select("b"))
    held = cut_lineage(ends.distinct())
    wanted = plain.join(held, "node").groupBy("node").agg(F.max("text").alias("text"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [np.unique(_hashes(t, shingle, 42)).view("<i8") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(made, pa.list_(pa.int64()))], ["node", "hs"])

    sets = cut_lineage(wanted.mapInArrow(shingles, "node binary, hs array<long>"))

    def passed(pairs: DataFrame) -> DataFrame:
        """Of pairs of structs ``x`` and ``y`` the nodes of those that may be similar."""
        ok = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")
        a, b = F.col("x.node"), F.col("y.node")
        return pairs.where(ok & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    member = F.struct("node", "n", "root")
    links = [cut_lineage(_similar(close, sets, similarity))]
    star = links[0].select(F.col("b").alias("node"), F.col("a").alias("root"))
    roots = cut_lineage(held.join(star, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    release(close, held)
    for turn in range(ROUNDS + 1):
        placed = live.join(roots, "node")
        first = F.min_by(member, F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("lead")
        leads = placed.groupBy("tag", "key").agg(first, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        asked = placed.join(leads, ["tag", "key"]).where("root <> lead.root")
        # One link joins a node to a group: it asks the leader of its largest key first, then one leader of each other group.
        other = [F.col("lead.root").alias("_group")] if turn else []
        largest = F.struct((-F.col("size")).alias("s"), "tag", "key")
        asked = asked.groupBy("node", *other).agg(F.min_by(F.struct(member.alias("x"), F.col("lead").alias("y")), largest).alias("p"))
        new = cut_lineage(_similar(passed(asked.select("p.x", "p.y")), sets, similarity))
        links.append(new)
        if new.isEmpty():
            break
        roots = _merged(roots, new)
    placed = live.join(roots, "node").select("tag", "key", "size", member.alias("x"), "root")
    apart = placed.groupBy("tag", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    split = cut_lineage(placed.join(apart.where("lo <> hi"), ["tag", "key"]))
    few = split.where(F.col("size") <= dense)
    other = few.select("tag", "key", F.col("x").alias("y"), F.col("root").alias("y_root"))
    pairs = few.join(other, ["tag", "key"]).where("root < y_root").select("x", "y")
    linked, many = _apart(split.where(F.col("size") > dense).select("tag", "key", "x.node", "root"), sets, similarity)
    links.append(linked)
    roots = _merged(roots, linked)
    todo = cut_lineage(passed(pairs).union(many).distinct())
    release(split, many)
    for most in WAVES:
        turn = F.row_number().over(W.partitionBy("ra", "rb").orderBy(F.xxhash64("a", "b"), "a", "b"))
        open_ = cut_lineage(_two_roots(todo, roots).select("a", "b", turn.alias("turn")))
        release(todo)
        now = open_ if most is None else open_.where(F.col("turn") <= most)
        todo = open_
        if now.isEmpty():
            break
        new = cut_lineage(_similar(now.select("a", "b"), sets, similarity))
        if most is not None:  # pairs that meet in one group by now are not looked at again
            todo = cut_lineage(open_.where(F.col("turn") > most).select("a", "b"))
            release(open_)
            roots = _merged(roots, new)
        links.append(new)
    roots = _contracted(roots, reduce(DataFrame.union, links))
    release(*links)
    whole = nodes.select("node", "id").join(roots, "node", "left").select(
        F.col("node"), F.coalesce("root", "node").alias("root"), "id"
    )
    lows = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    named = whole.join(lows, "root").select("node", "component_id")
    release(live, sets, todo)
    return rows.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "node", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group of similar texts; all columns stay.

    Of repeated rows with the kept id and one text one stays. Rows without an id stay as they are."""
    node = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), node.alias("node"))
    with_id = whole.where("id is not null")
    named = similar_groups(docs.where(F.col(id_col).isNotNull()), id_col, text, similarity=similarity)
    kept = named.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("id"), "node").distinct()
    one = with_id.join(kept, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    return one.union(whole.where("id is null").select(*one.columns)).select("row.*")
