"""Documents as lines, sections, chunks and scanned spans. Work inside one document is a function
of its own cell or lines; anything across documents is a plain aggregation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import once, prefixes, rejoin, running, slice_of
from .report import ordered_concat

# --- lines ------------------------------------------------------------------------------------


def compact(c: Column) -> Column:
    """Runs of blanks and tabs become one blank."""
    return F.trim(F.regexp_replace(c, "[ \t]+", " "))


def explode_lines(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per non-empty line, numbered from 1 over all lines of the document."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    return docs.select(ident, F.posexplode(lines).alias("_p", "_l")).select(
        ident, (F.col("_p") + 1).alias("line_no"), compact(F.col("_l")).alias("line")
    ).filter("line <> ''")


# The line patterns; the first class that matches wins.
_SEGMENT = r"(?:[0-9]+|[IVXLCDM]+|[A-Z])"
LINE_PATTERNS = {
    "section": rf"^\s*({_SEGMENT}(?:\.{_SEGMENT})*)\.\s+(.*\S)?\s*$",
    "clause": r"^([0-9]+(?:\.[0-9]+)+)\.?\s+(.*\S.*)$",
    "bullet": "^\\s*[-*•●]\\s+(.*\\S.*)$",
}
LIST_HEADER = r"^([0-9]+(?:\.[0-9]+)+)\.?\s+([A-Z].+)$"


def detect_headings(lines: DataFrame, ident: str, line: str = "line", order: str = "line_no") -> DataFrame:
    """Class, number and body of each line; a clause with a capitalised title followed by a bullet
    is a list header."""
    c = F.col(line)
    kind, number, body = F.lit("text"), F.lit(None).cast("string"), c
    for name, pattern in reversed(LINE_PATTERNS.items()):
        hit = c.rlike(pattern)
        kind = F.when(hit, name).otherwise(kind)
        at = 1 if name == "bullet" else 2
        body = F.when(hit, F.regexp_extract(c, pattern, at)).otherwise(body)
        number = F.when(hit, F.lit(None) if name == "bullet" else F.regexp_extract(c, pattern, 1)).otherwise(number)
    out = lines.withColumns({"line_class": kind, "number": number, "body": body})
    follows = F.lead("line_class").over(W.partitionBy(ident).orderBy(order)) == "bullet"
    header = (F.col("line_class") == "clause") & c.rlike(LIST_HEADER) & F.coalesce(follows, F.lit(False))
    return out.withColumn("line_class", F.when(header, "list_header").otherwise(F.col("line_class")))


def inherit_number(
    lines: DataFrame, ident: str, raw: str, order: str = "line_no", name: str = "number"
) -> DataFrame:
    """Unnumbered lines take the last number above them, ``0`` before the first. Only dotted digits
    count as a number; a closing dot or bracket is dropped."""
    tidy = F.regexp_replace(F.trim(raw), "[.)]$", "")
    valid = F.when(tidy.rlike(r"^[0-9]+(\.[0-9]+)*$"), tidy)
    out = running(lines, [ident], slice_of(F.col(order), 1000), [F.col(order)], {"_num": ("last", valid)})
    kept = [c for c in lines.columns if c != name]
    return out.select(*kept, F.coalesce("_num", F.lit("0")).alias(name))


def sort_key(number: Column) -> Column:
    """An array of (kind, number, text) per segment, which sorts 2 before 10 and numbers before letters."""

    def segment(s: Column) -> Column:
        digits = F.when(s.rlike("^[0-9]+$"), s.try_cast("decimal(38,0)"))
        return F.struct(
            F.when(digits.isNotNull(), 0).otherwise(1).alias("kind"),
            F.coalesce(digits, F.lit(0)).cast("decimal(38,0)").alias("number"),
            F.when(digits.isNotNull(), "").otherwise(F.lower(s)).alias("text"),
        )

    return F.transform(F.split(number, r"\."), segment)


def _unit_columns(ident: str, number: Column, first_row: str) -> dict[str, Column]:
    """What a unit's number says about it, and its id: a digest of document, number and first row."""
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return {
        "level": F.when(dots == 0, "SECTION").when(dots == 1, "SUBSECTION").otherwise("CLAUSE"),
        "parent_number": F.when(dots > 0, F.regexp_extract(number, r"^(.*)\.[^.]*$", 1)),
        "sort_key": sort_key(number),
        "unit_id": F.md5(F.concat_ws("|", F.col(ident).cast("string"), number, F.col(first_row).cast("string"))),
    }


def section_units(
    lines: DataFrame, ident: str, number: str, text: str, title: str, heading: str, order: str = "line_no"
) -> DataFrame:
    """One row per (document, number): first title, heading flag, row span, joined text, level,
    parent number, sort key and a stable id."""
    joined = ordered_concat(lines.filter(F.col(text) != ""), [ident, number], text, [order])
    spans = lines.groupBy(ident, number).agg(
        F.min_by(title, order).alias("title"), F.max(heading).alias("is_heading"),
        F.min(order).alias("first_row"), F.max(order).alias("last_row"),
    )
    return rejoin(spans, joined, [ident, number]).select(
        ident,
        number,
        F.when(F.col("is_heading") == 1, F.col("title")).alias("heading"),
        "is_heading",
        "first_row",
        "last_row",
        F.coalesce(F.col(text), F.lit("")).alias(text),
        *[c.alias(n) for n, c in _unit_columns(ident, F.col(number), "first_row").items()],
    )


BULLET = r"(?im)^\s*(?:[-*•]|\([a-z]\))\s+(.*\S)\s*$"


def split_bullets(units: DataFrame, ident: str, number: str, text: str) -> DataFrame:
    """Bullets of a unit as child units numbered 1, 2, 3, ... in order."""
    found = F.regexp_extract_all(text, F.lit(BULLET), 1)
    rows = units.select(ident, F.col(number).alias("parent_number"), F.posexplode(found).alias("_p", text))
    child = F.concat_ws(".", F.col("parent_number"), F.col("_p") + 1)
    return rows.select(ident, child.alias(number), "parent_number", text)


def with_bullets(units: DataFrame, ident: str, number: str, text: str) -> DataFrame:
    """``section_units`` with the bullets of a unit in its place: child units of the same row span with level,
    parent, sort key and id of their own. Units without bullets stay as they are."""
    found = F.regexp_extract_all(text, F.lit(BULLET), 1)
    opened = once(units, _b=found)
    bullets = opened.select(*units.columns, F.posexplode("_b").alias("_p", "_t"))
    child = F.concat_ws(".", F.col(number), F.col("_p") + 1)
    bullets = bullets.withColumns({number: child, text: F.col("_t"), "heading": F.lit(None).cast("string"), "is_heading": F.lit(0)})
    bullets = bullets.withColumns(_unit_columns(ident, F.col(number), "first_row")).select(*units.columns)
    return opened.filter(F.size("_b") == 0).select(*units.columns).unionByName(bullets)


def section_rollup(
    lines: DataFrame, ident: str, number: str, prefix: str, title: str, text: str, order: str = "line_no",
    children: bool = True,
) -> DataFrame:
    """Text of a section and its children per document, a header line where the number changes."""
    n = F.col(number)
    kept = lines.filter(n.startswith(prefix) if children else n == prefix)
    changed = F.coalesce(F.lag(number).over(W.partitionBy(ident).orderBy(order)) != n, F.lit(True))
    head = F.when(changed, F.trim(F.concat_ws(" ", number, title)))
    body = F.when(F.trim(text) != "", F.trim(text))
    return ordered_concat(kept.withColumn(text, F.concat_ws("\n", head, body)), [ident], text, [order])


# --- items and chunks -------------------------------------------------------------------------


def enumeration_items(c: Column) -> Column:
    """Items of a list text: split at line breaks and at markers such as ``1)``, ``2.``, ``3-``."""
    mark = "\u0001"
    marked = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"\s*([0-9]+[).\-]\s)", mark + "$1")
    parts = F.split(marked, f"[\n{mark}]+", -1)
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), r"^[0-9]+[).\-]\s*", "")))
    return F.filter(clean, lambda p: p != "")


def split_enumerations(df: DataFrame, ident: str, text: str) -> DataFrame:
    return df.select(ident, F.posexplode(enumeration_items(F.col(text))).alias("_p", "item")).select(
        ident, (F.col("_p") + 1).alias("item_no"), "item"
    )


def chunk_documents(
    docs: DataFrame, ident: str, text: str, size: int, overlap: int, unit: str = "word"
) -> DataFrame:
    """Overlapping chunks that together cover the whole text, with their position and start.

    ``word`` counts words, so no chunk cuts one; ``char`` counts characters."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    if unit == "word":
        words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
        base = docs.select(ident, words.alias("_t")).withColumn("_n", F.size("_t"))
        piece = F.array_join(F.slice("_t", F.col("_s") + 1, F.lit(size)), " ")
    else:
        base = docs.select(ident, F.col(text).alias("_t")).withColumn("_n", F.length("_t"))
        piece = F.substring(F.col("_t"), F.col("_s") + 1, F.lit(size))
    last = F.greatest(F.col("_n") - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    return base.filter("_n > 0").select("*", F.posexplode(starts).alias("chunk_no", "_s")).select(
        ident, "chunk_no", F.col("_s").alias("start"), piece.alias("chunk")
    )


def is_low_value(c: Column) -> Column:
    """Boilerplate and very short requirement texts."""
    t = F.trim(F.lower(c))
    vague = t.rlike(r"\bmust be (known|communicated)\b") & ~t.contains("procedure") & ~t.contains("policy")
    short = F.size(F.filter(F.split(t, r"\s+", -1), lambda w: w != "")) < 5
    generic = t.contains("this control requirement") | t.contains("the control requirement")
    return generic | vague | short


def low_value_filter(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("is_low_value", is_low_value(F.col(text)))


# --- personal data ----------------------------------------------------------------------------

# The span patterns per label.
PII_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "PHONE_NUMBER": r"\+?\d[\d\-\s()]{7,}\d",
}


def _labelled_spans(found: DataFrame, text: str) -> DataFrame:
    """Add ``_spans`` (label, start, end), by label and start; touching spans of one label are one.

    ``split`` gives the lengths between the matches that ``regexp_extract_all`` returns, and their running sum
    the positions. All labels share one running sum: the pieces of each add up to the text."""
    c, n = F.col(text), F.length(text).cast("long")
    mail, number = c.contains("@"), c.rlike("[0-9]")
    pieces = []
    for k, (label, pattern) in enumerate(PII_PATTERNS.items()):
        # Without an @ there is no address, and without a digit nothing else.
        possible = mail if label == "EMAIL" else number
        none = F.array(F.struct(n.alias("gap"), F.lit(None).cast("long").alias("hit")))
        pieces.append(F.transform(F.when(possible, _pieces(c, pattern)).otherwise(none), _tagged(k)))
    out = once(found, _p=F.concat(*pieces))
    out = prefixes(out, "_p", "_at", lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0)), lambda x, y: x + y, F.lit(0).cast("long"))
    size = F.length(text).cast("long")

    def span(x: Column, i: Column) -> Column:
        start = F.get("_at", i) + x["gap"] - x["k"] * size
        before = F.get("_p", i - 1)
        follows = (x["gap"] == 0) & F.coalesce((before["k"] == x["k"]) & before["hit"].isNotNull(), F.lit(False))
        return F.struct(x["k"].alias("k"), start.alias("start"), (start + x["hit"]).alias("end"), (~follows).alias("opens"))

    out = once(out, _s=F.filter(F.transform("_p", span), lambda x: x["end"].isNotNull())).drop("_p", "_at")
    out = _islands(out, "_s")
    labels = F.array(*[F.lit(x) for x in PII_PATTERNS])
    whole = F.transform(
        "_first",
        lambda i, j: F.struct(
            F.get(labels, F.get("_s", i)["k"]).alias("label"), F.get("_s", i)["start"].cast("int").alias("start"),
            F.get("_s", F.coalesce(F.get("_first", j + 1), F.size("_s")) - 1)["end"].cast("int").alias("end"),
        ),
    )
    return once(out, _spans=whole).drop("_s", "_first")


def _pieces(c: Column, pattern: str) -> Column:
    def pair(gap: Column, hit: Column) -> Column:
        return F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("hit"))

    return F.zip_with(F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), pair)


def _tagged(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), x["gap"].alias("gap"), x["hit"].alias("hit"))


def _islands(df: DataFrame, items: str) -> DataFrame:
    """Add ``_first``: the places of the elements that open an island (field ``opens``)."""
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return once(df, _first=F.filter(places, lambda i: F.get(items, i)["opens"]))


def scan_pii(docs: DataFrame, ident: str, text: str, context: int = 40) -> dict[str, DataFrame]:
    """``spans`` with value and context, ``redacted`` texts, and a ``summary`` per label.

    Overlapping spans of one label are merged; where labels overlap, the earlier span is redacted
    and the rest of the later one with it. Everything but the summary stays inside the row, so no
    text is shuffled, and only built-in expressions run."""
    c = F.col(text)
    possible = c.contains("@") | c.rlike("[0-9]")
    found = _labelled_spans(docs.select(ident, text).filter(possible), text)
    lo = F.greatest(F.col("s.start") - context, F.lit(0))
    spans = found.select(ident, text, F.explode("_spans").alias("s")).select(
        ident, "s.label", "s.start", "s.end",
        F.substring(c, F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"),
        F.substring(c, lo + 1, F.col("s.end") + context - lo).alias("context"),
    )
    redacted = _redacted(_labelled_spans(docs.select(ident, text), text), ident, text)
    summary = spans.groupBy("label").agg(
        F.count(F.lit(1)).alias("spans"), F.countDistinct(ident).alias("documents"), F.min("context").alias("example")
    )
    return {"spans": spans, "redacted": redacted, "summary": summary}


def _redacted(found: DataFrame, ident: str, text: str) -> DataFrame:
    """Overlapping spans of all labels as one cut, which bears the label of the first."""
    by_start = F.array_sort(
        F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    )
    out = once(found, _c=by_start).drop("_spans")
    out = prefixes(out, "_c", "_end", lambda x: x["end"], lambda x, y: F.greatest(x, y), F.lit(0))

    def marked(x: Column, i: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["label"].alias("label"), (x["start"] >= F.get("_end", i)).alias("opens"))

    out = _islands(once(out, _c=F.transform("_c", marked)), "_c")

    def piece(i: Column, j: Column) -> Column:
        first = F.get("_c", i)
        at = F.get("_end", i)
        return F.concat(
            F.substring(F.col(text), at + 1, first["start"] - at), F.lit("[REDACTED_"), first["label"], F.lit("]")
        )

    rest = F.substring(F.col(text), F.get("_end", F.size("_c")) + 1, F.length(text))
    whole = F.concat(F.array_join(F.transform("_first", piece), ""), rest)
    return out.select(ident, F.coalesce(whole, F.col(text)).alias("redacted"))


# --- answers ----------------------------------------------------------------------------------


def clean_answer_text(
    c: Column, cut_at: str | None = None, drop_prefixes: tuple[str, ...] = ("RESPONSE", "ANSWER"),
    max_chars: int | None = None,
) -> Column:
    """Think blocks, answer prefix and markdown stars removed, white space collapsed; optionally cut
    at a marker and shortened at the end of a sentence."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")
    if cut_at:
        out = F.regexp_replace(out, f"(?is){re.escape(cut_at)}.*$", "")
    out = F.regexp_replace(F.trim(out), f"(?i)^({'|'.join(drop_prefixes)}):\\s*", "")
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "$1")
    out = F.regexp_replace(out, r"\*([^*]+)\*", "$1")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    if max_chars is None:
        return out
    head = F.substring(out, 1, max_chars)
    stop = F.length(head) - F.locate(".", F.reverse(head)) + 1
    whole = (F.locate(".", head) > 0) & (stop > 101)
    short = F.when(whole, F.substring(head, F.lit(1), stop)).otherwise(head)
    return F.when(F.length(out) > max_chars, F.concat(short, F.lit(" …"))).otherwise(out)


def assemble_prompts(
    lines: DataFrame, keys: list[str], text: str, order: list[str], template: str, variants: list[str],
    context: str | None = None,
) -> DataFrame:
    """One prompt per key and variant: numbered requirement list and context lines in ``template``
    with the fields {variant}, {items} and {context}."""
    item = F.struct(*order, F.col(text).alias("_text"), (F.col(context) if context else F.lit(None).cast("string")).alias("_ctx"))
    rows = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    items = F.array_join(
        F.transform("_rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit(") "), r["_text"])), "\n"
    )
    extra = F.array_join(F.array_distinct(F.filter(F.transform("_rows", lambda r: r["_ctx"]), lambda x: x.isNotNull())), "\n")
    out = F.lit(template)
    named = rows.withColumns({"_items": items, "_context": extra}).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    for field, c in (("{variant}", "variant"), ("{items}", "_items"), ("{context}", "_context")):
        out = F.replace(out, F.lit(field), F.col(c))
    return named.select(*keys, "variant", out.alias("prompt"))


def fan_out_unique(df: DataFrame, text: str, ident: str, models: list[str]) -> DataFrame:
    """Work list of every distinct text and model: ``(text_key, text, model)``. Texts are keyed by
    hash, so a popular text costs one row however many ids share it."""
    unique = df.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("text_key")).agg(
        F.first(text).alias(text), F.count(ident).alias("ids")
    )
    return unique.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def fan_in_results(df: DataFrame, results: DataFrame, text: str, ident: str, cols: list[str]) -> DataFrame:
    """One result per text and model, attached back to every id."""
    keyed = df.select(ident, F.sha2(text, 256).alias("text_key"))
    return keyed.join(results.select("text_key", "model", *cols), "text_key", "left").select(ident, "model", *cols)
