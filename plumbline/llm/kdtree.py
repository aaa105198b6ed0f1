"""K-d tree shards: distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.frames import number_rows
from plumbline.session import cut_lineage, release

#: Histogram buckets per node and step, rows per numbering bucket.
BUCKETS, NUMBER_ROWS = 512, 5000


def ordinal(c: str | Column) -> Column:
    """A text as a number that keeps the order of its first six UTF-8 bytes; null is below all texts."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


@dataclass
class _Cut:
    """Where a node is split: all rows up to and with ``key`` along ``dim`` go left."""

    dim: int
    target: float
    low: int
    high: int
    key: tuple[int, ...] = ()
    below: float = 0.0


def _chosen(cuts: dict[int, _Cut], of) -> Column:
    """A per-node constant as a column; there are as many nodes as leaves at most."""
    out = None
    for node, cut in cuts.items():
        v = F.lit(of(cut))
        out = F.when(F.col("_node") == node, v) if out is None else out.when(F.col("_node") == node, v)
    return out


def _key_parts(cuts: dict[int, _Cut], dims: list[str]) -> list[Column]:
    """The sort key of a row in its node: the node's dimension, then the tie columns."""
    value = None
    for node, cut in cuts.items():
        v = F.col(dims[cut.dim])
        value = F.when(F.col("_node") == node, v) if value is None else value.when(F.col("_node") == node, v)
    return [value, F.col("_tie"), F.col("_tie2")]


def _refine(rows: DataFrame, cuts: dict[int, _Cut], parts: list[Column], depth: int) -> None:
    """Narrow part ``depth`` of every node's cut key to the one value where the running weight meets its target."""
    active = dict(cuts)
    while active:
        within = F.col("_node").isin(list(active))
        for p in range(depth):
            within = within & (parts[p] == _chosen(active, lambda c, p=p: c.key[p]))
        low, high = _chosen(active, lambda c: c.low), _chosen(active, lambda c: c.high)
        spot = F.floor((parts[depth] - low) / ((high - low + 1) / BUCKETS)).cast("int")
        seen = rows.where(within & parts[depth].between(low, high)).groupBy("_node", spot.alias("_b"))
        found = seen.agg(F.sum("_w").alias("w"), F.min(parts[depth]).alias("lo"), F.max(parts[depth]).alias("hi"))
        by: dict[int, list] = {}
        for r in found.collect():  # nodes x BUCKETS rows at most
            by.setdefault(r._node, []).append(r)
        for node, bins in by.items():
            cut = active[node]
            for r in sorted(bins, key=lambda r: r._b):
                if cut.below + r.w >= cut.target or r is max(bins, key=lambda r: r._b):
                    break
                cut.below += r.w
            cut.low, cut.high = r.lo, r.hi
            if r.lo == r.hi:
                cut.key += (r.lo,)
                del active[node]


def shards(
    rows: DataFrame, dims: list[str], weight: str, ties: tuple[str, str], target: int | None = None, leaves: int | None = None
) -> DataFrame:
    """``rows`` with a long column ``shard``: the leaves of a k-d tree of about ``target`` weight each, from 0.

    ``dims``, ``weight`` and ``ties`` are long columns without nulls; dims lie within 2^62 of each other. A node of
    several leaves is cut along the dimension whose spread is the largest share of its spread over all rows, at the
    weighted quantile that gives both sides their share of leaves. Rows of one value are parted by the tie columns,
    so cuts are exact to a row unless rows agree in everything. Medians come from histograms that are narrowed until
    one value is left; the driver sees ``BUCKETS`` sums per node."""
    cols = rows.columns
    base = rows.withColumns({"_node": F.lit(0).cast("long"), "_w": F.col(weight).cast("long")})
    base = base.withColumns({"_tie": F.col(ties[0]), "_tie2": F.col(ties[1])})
    now = cut_lineage(base)
    whole = now.agg(F.sum("_w").alias("w"), *[(F.max(d) - F.min(d)).alias(f"s{i}") for i, d in enumerate(dims)]).first()
    leaves = leaves or max(1, -(-(whole.w or 0) // target))
    open_ = {0: (leaves, 0)}  # node -> leaves below it, number of the first
    done: dict[int, int] = {}
    while open_:
        for node, (n, first) in list(open_.items()):
            if n == 1:
                done[node] = first
                del open_[node]
        if not open_:
            break
        spans = [F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias(f"d{i}") for i, d in enumerate(dims)]
        stats = now.where(F.col("_node").isin(list(open_))).groupBy("_node").agg(F.sum("_w").alias("w"), *spans).collect()
        cuts = {}
        for r in stats:
            wide = [(r[f"d{i}"].hi - r[f"d{i}"].lo) / (whole[f"s{i}"] or 1) for i in range(len(dims))]
            dim = max(range(len(dims)), key=lambda i: (wide[i], -i))
            n = open_[r._node][0]
            cuts[r._node] = _Cut(dim, r.w * (n // 2) / n, r[f"d{dim}"].lo, r[f"d{dim}"].hi)
        below = {}
        for node, (n, first) in open_.items():
            below[2 * node + 1] = (n // 2, first)
            below[2 * node + 2] = (n - n // 2, first + n // 2)
        open_ = below
        if not cuts:  # no rows are left in any open node
            break
        parts = _key_parts(cuts, dims)
        _refine(now, cuts, parts, 0)
        for depth in (1, 2):
            same = F.lit(True)
            for p in range(depth):
                same = same & (parts[p] == _chosen(cuts, lambda c, p=p: c.key[p]))
            ends = now.where(F.col("_node").isin(list(cuts)) & same).groupBy("_node")
            for r in ends.agg(F.min(parts[depth]).alias("lo"), F.max(parts[depth]).alias("hi")).collect():
                cuts[r._node].low, cuts[r._node].high = r.lo, r.hi
            _refine(now, cuts, parts, depth)
        last = len(parts) - 1
        upto = parts[last] <= _chosen(cuts, lambda c: c.key[last])
        for p in reversed(range(last)):
            at = _chosen(cuts, lambda c, p=p: c.key[p])
            upto = (parts[p] < at) | ((parts[p] == at) & upto)
        child = F.when(F.col("_node").isin(list(cuts)), 2 * F.col("_node") + F.when(upto, 1).otherwise(2))
        after = cut_lineage(now.withColumn("_node", F.coalesce(child, F.col("_node")).cast("long")))
        release(now)
        now = after
    shard = None
    for node, number in done.items():
        v = F.lit(number)
        shard = F.when(F.col("_node") == node, v) if shard is None else shard.when(F.col("_node") == node, v)
    return now.select(*cols, (F.lit(0) if shard is None else shard).cast("long").alias("shard"))


def shard_documents(
    docs: DataFrame, leaves: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` per row of ``docs``: shards of near equal bytes, slots gapless from 0.

    Size is the UTF-8 bytes of the text (null: none) plus 1. The dimensions are size, language, source and id as far
    as ``docs`` has them (columns of other types than text or number are passed over); a null is below all values.
    Equal texts lie next to each other along size, checksum and id, so a cut parts a group of copies only where it
    must to keep the shards equal. Repeated rows go to one shard. An empty table gives an empty result."""
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = dict(docs.dtypes)
    # Ids take part with a bound of 2^61 on either side, which keeps differences inside a long.
    narrow = lambda c: F.coalesce(F.greatest(F.least(c.cast("long"), F.lit(1 << 61)), F.lit(-(1 << 61))), F.lit(-(1 << 61)))
    dims = {"_d0": F.octet_length(body).cast("long") + 1}
    for name in ("lang", "source"):
        if kinds.get(name) == "string" and name not in (id_col, text):
            dims[f"_d{len(dims)}"] = ordinal(name)
    dims[f"_d{len(dims)}"] = narrow(F.col(id_col))
    rows = docs.select(
        F.col(id_col).alias("_id"), *[c.alias(n) for n, c in dims.items()], F.crc32(body.cast("binary")).alias("_crc")
    ).withColumn("_pos", narrow(F.col("_id")))
    placed = shards(rows, list(dims), "_d0", ("_crc", "_pos"), target_bytes, None if target_bytes else leaves)
    placed = cut_lineage(placed.select("_id", F.col("_d0").alias("size"), F.col("_crc").alias("text_crc32"), "shard"))
    groups = max(1, placed.count() // NUMBER_ROWS)
    spread = placed.withColumn("_b", F.pmod(F.xxhash64("_id", "text_crc32"), F.lit(groups)))
    numbered = number_rows(spread, ["shard"], F.col("_b"), [F.col("_b"), F.col("text_crc32"), F.col("_id")], "_n")
    return numbered.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_n") - 1).alias("slot")
    )
