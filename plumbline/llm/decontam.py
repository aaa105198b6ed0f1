"""Benchmark decontamination as a prefix-filtered set join of word shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.names import free_name
from plumbline.session import cut_lineage

#: Words of an item that must occur in a row, and words of the shingles that stand for them in the join.
WINDOW = 10
SHINGLE = 5
#: Bits of the shingle filter per benchmark shingle, and the most bits it may have (8 MB).
FILTER_BITS = 64
FILTER_MOST = 1 << 26

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters and all non-ASCII characters. Null has none."""
    low = F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, _GAP), "")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, size, words)``: the distinct windows of every item; an item of fewer words is one window."""
    words = items.select(F.col(item_id).alias("item"), words_of(text).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(WINDOW))
    at = words.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    return at.select("item", "size", F.slice("w", F.col("i"), F.col("size")).alias("words")).distinct()


def _bit_filter(shingles: DataFrame) -> tuple[DataFrame, int]:
    """One row with the words of a bit array of the shingle hashes, and its length in 64-bit words.

    The array has ``FILTER_BITS`` bits per shingle, up to ``FILTER_MOST`` in all; beyond that more positions pass the
    filter and are settled by the join, so the result stays the same."""
    n = shingles.count()
    length = 1 << 10
    while length * 64 < min(n * FILTER_BITS, FILTER_MOST):
        length *= 2
    place = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(length - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    held = shingles.groupBy(place.alias("p")).agg(F.bit_or(bit).alias("b"))
    spark = shingles.sparkSession
    full = spark.range(length).join(held, F.col("id") == F.col("p"), "left")
    rows = full.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")))).alias("r"))
    return rows.select(F.col("r.b").alias("bits")), length


def _positions(docs: DataFrame, shingles: DataFrame, size: int, mark: bool) -> DataFrame:
    """Document positions whose shingle of ``size`` words may be a benchmark shingle, each with the words around it.

    With ``mark`` every document also yields a row at position 0, which carries its word count."""
    bits, length = _bit_filter(shingles)
    n = F.size("w")
    rows = docs.select("row", "w", F.explode(F.sequence(F.lit(0), F.greatest(n - size + 1, F.lit(0)))).alias("i"))
    rows = rows.withColumn("h", F.xxhash64(F.slice("w", F.greatest("i", F.lit(1)), F.lit(size))))
    word = F.get(bits.scalar(), F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(length - 1)).cast("int"))
    shift = F.col("h").bitwiseAND(F.lit(63)).cast("int")
    hit = F.call_function("shiftrightunsigned", word, shift).bitwiseAND(F.lit(1)) == 1
    here = (F.col("i") > 0) & hit
    kept = rows.where(((F.col("i") == 0) | here) if mark else here)
    first = F.greatest(F.col("i") - (WINDOW - size), F.lit(1))
    around = F.slice("w", first, F.col("i") + WINDOW - first)
    return kept.select(
        "row",
        n.alias("n"),
        "i",
        F.lit(size).alias("size"),
        "h",
        F.when(F.col("i") > 0, first).alias("first"),
        F.when(F.col("i") > 0, around).alias("around"),
    )


def benchmark_hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(row, n_words, n_hit, items)`` per row of ``docs``, where ``row`` is ``docs.row``, a unique number.

    Every window is the set of its shingles. Shingles are ordered by how often documents hold them, rarest
    first; as a window must be contained whole, its necessary prefix is its one rarest shingle. Document positions
    of that shingle are candidates; they must leave room for the window before and behind, and the words are then
    compared. One pass reads the documents; what it keeps are the positions that pass a bounded bit filter of the
    benchmark's shingles."""
    windows = cut_lineage(item_windows(items, item_id, item_text))
    width = F.least(F.col("size"), F.lit(SHINGLE))
    shingled = windows.select(
        "item", "size", "words", width.alias("width"),
        F.explode(F.sequence(F.lit(1), F.col("size") - width + 1)).alias("o"),
    ).withColumn("h", F.xxhash64(F.slice("words", F.col("o"), F.col("width"))))
    widths = sorted(r.width for r in shingled.select("width").distinct().collect()) or [SHINGLE]
    split = docs.select("row", words_of(text).alias("w"))
    found = None
    for k, size in enumerate(widths):
        part = _positions(split, shingled.where(F.col("width") == size).select("h").distinct(), size, k == 0)
        found = part if found is None else found.union(part)
    found = cut_lineage(found)
    hits = found.where("i > 0")
    counts = hits.groupBy("size", "h").agg(F.count(F.lit(1)).alias("n_docs")).withColumnRenamed("size", "width")
    # A shingle that no document holds is the rarest: its window cannot occur and takes part no further.
    rarest = (
        shingled.join(counts, ["width", "h"], "left")
        .groupBy("item", "size", "words")
        .agg(F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "o", "width", "h")).alias("p"))
        .where("p.n_docs > 0")
        .groupBy("words", "size", "p")
        .agg(F.collect_set("item").alias("items"))
        .select("words", F.col("size").alias("long"), "items", "p.o", F.col("p.width").alias("width"), "p.h")
    )
    start = F.col("i") - F.col("o") + 1
    joined = hits.withColumnRenamed("size", "width").join(rarest, ["width", "h"])
    fits = (start >= 1) & (start + F.col("long") - 1 <= F.col("n"))
    equal = F.slice("around", start - F.col("first") + 1, F.col("long")) == F.col("words")
    occurrences = joined.where(fits).where(equal)
    per_row = (
        occurrences.select("row", start.alias("start"), (start + F.col("long") - 1).alias("end"), F.explode_outer("items").alias("item"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set("item").alias("items"))
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto")),
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(x["end"] - F.greatest(s["upto"], x["start"] - 1), F.lit(0))).cast("long").alias("hit"),
            F.greatest(s["upto"], x["end"]).alias("upto"),
        ),
        lambda s: s["hit"],
    )
    counted = found.where("i = 0").select("row", F.col("n").cast("long").alias("n_words"))
    return counted.join(per_row.select("row", covered.alias("n_hit"), "items"), "row", "left").select(
        "row",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast(per_row.schema["items"].dataType)).alias("items"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(id, n_words, n_hit, items)`` per row of ``docs``: its words, those inside an occurrence of an item's
    window of 10 words (all of a shorter item), and the ids of the items with such windows.

    Null and wordless texts and items have no words and no hits. Items of equal text all count; an item without an id
    hits words but is not named. Repeated rows and
    rows without an id give a row each. Empty tables give no hits or an empty result. Other columns are ignored."""
    numbered = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).withColumn(
        "row", F.struct("_id", F.monotonically_increasing_id().alias("n"))
    )
    hits = benchmark_hits(numbered, items, "_text", item_id, item_text)
    return hits.select(F.col("row._id").alias(id_col), "n_words", "n_hit", "items")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of an item; all columns stay.

    Rows are told by id and text, so an id with two texts loses only the contaminated one."""
    h, bad_id, bad_h = (free_name(n, docs.columns) for n in ("_h", "_id", "_hb"))
    keyed = docs.withColumn(h, F.xxhash64(F.col(text)))
    rows = keyed.select(F.struct(F.col(id_col).alias("_id"), F.col(h).alias("_h")).alias("row"), F.col(text).alias("_text"))
    bad = benchmark_hits(rows, items, "_text").where("n_hit > 0")
    bad = bad.select(F.col("row._id").alias(bad_id), F.col("row._h").alias(bad_h)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(h) == F.col(bad_h))
    return keyed.join(bad, same, "left_anti").select(*docs.columns)
