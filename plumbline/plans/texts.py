"""Text jobs and pair scores on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import pairs as p
from ..operators import text as t
from ..operators.report import ordered_concat
from ..session import shared_dir
from ..sources.text import read_text_corpus
from .registry import load, query
from .reporting import rounded

SQL_LINES = """raw AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS l,
 unnest(range(1, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) + 1)) AS no FROM documents),
 lines AS (SELECT doc_id, CAST(no AS INTEGER) AS line_no, trim(regexp_replace(l, '[ \\t]+', ' ', 'g')) AS line FROM raw WHERE trim(regexp_replace(l, '[ \\t]+', ' ', 'g')) <> '')"""

# Numbering derived from the line position turns the prose into a policy-like outline.
OUTLINE = """CASE WHEN line_no % 6 = 1 THEN concat(CAST(floor(line_no / 6) + 1 AS {i}), '. ', line)
 WHEN line_no % 6 = 3 THEN concat(CAST(floor(line_no / 6) + 1 AS {i}), '.', CAST(line_no AS {i}), ' ', line)
 WHEN line_no % 6 = 4 THEN concat('- ', line) ELSE line END"""
NUMBER = """CASE WHEN line_no % 6 = 3 THEN concat(CAST(floor(line_no / 6) + 1 AS {i}), '.', CAST(line_no AS {i}), ')')
 WHEN line_no % 6 = 5 THEN concat(CAST(floor(line_no / 6) + 1 AS {i}), '.') WHEN line_no % 6 = 0 THEN 'context' END"""


def _lines(spark, d):
    return t.explode_lines(load(spark, d, "documents"), "doc_id", "text")


@query("explode_lines", f"WITH {SQL_LINES} SELECT * FROM lines")
def _(spark, d):
    return _lines(spark, d)


@query("read_text_corpus", """SELECT 'c' || conv_id AS doc_id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id % 4 || '.1' END AS version,
 string_agg(CASE WHEN conv_id % 2 = 0 THEN regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g') ELSE text END || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def _(spark, d):
    """Every conversation as a file of its own, each second one in latin-1, read back."""
    turns = load(spark, d, "conversations")
    plain = F.regexp_replace("text", "[^\\x00-\\xff]", "?")
    turns = turns.withColumn("text", F.when(F.col("conv_id") % 2 == 0, plain).otherwise(F.col("text")))
    files = ordered_concat(turns, ["conv_id"], "text", ["turn"])
    version = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("-v"), (F.col("conv_id") % 4).cast("string"), F.lit(".1")))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.coalesce(version, F.lit("")), F.lit(".txt"))
    raw = F.when(F.col("conv_id") % 2 == 0, F.encode("text", "ISO-8859-1").cast("string")).otherwise(F.col("text"))
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    files.select(raw.alias("value"), name.alias("file")).write.partitionBy("file").text(path)
    return read_text_corpus(spark, path, name_at=-2, id_pattern=r"^file=(.*?)(?:-v[\d.]+)?\.[^.]+$").select("doc_id", "version", "text")


SEC, CLA, BUL = (t.LINE_PATTERNS[k] for k in ("section", "clause", "bullet"))


@query("detect_headings", f"""WITH {SQL_LINES}, o AS (SELECT doc_id, line_no, {OUTLINE.format(i='INTEGER')} AS line FROM lines),
k AS (SELECT *, CASE WHEN regexp_matches(line, '{SEC}') THEN 'section' WHEN regexp_matches(line, '{CLA}') THEN 'clause' WHEN regexp_matches(line, '{BUL}') THEN 'bullet' ELSE 'text' END AS c FROM o),
n AS (SELECT *, lead(c) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM k)
SELECT doc_id, line_no, CASE WHEN c = 'clause' AND nx = 'bullet' AND regexp_matches(line, '{t.LIST_HEADER}') THEN 'list_header' ELSE c END AS line_class,
 CASE c WHEN 'section' THEN regexp_extract(line, '{SEC}', 1) WHEN 'clause' THEN regexp_extract(line, '{CLA}', 1) END AS number,
 CASE c WHEN 'section' THEN regexp_extract(line, '{SEC}', 2) WHEN 'clause' THEN regexp_extract(line, '{CLA}', 2) WHEN 'bullet' THEN regexp_extract(line, '{BUL}', 1) ELSE line END AS body FROM n""")
def _(spark, d):
    outline = _lines(spark, d).withColumn("line", F.expr(OUTLINE.format(i="INT")))
    return t.detect_headings(outline, "doc_id").drop("line")


NUMBERED = f"""{SQL_LINES}, x AS (SELECT doc_id, line_no, line, {NUMBER.format(i='INTEGER')} AS raw_no FROM lines),
y AS (SELECT *, regexp_replace(trim(raw_no), '[.)]$', '') AS tidy FROM x),
num AS (SELECT doc_id, line_no, line, coalesce(last_value(CASE WHEN regexp_matches(tidy, '^[0-9]+([.][0-9]+)*$') THEN tidy END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '0') AS number FROM y)"""


def _numbered(spark, d):
    raw = _lines(spark, d).withColumn("raw_no", F.expr(NUMBER.format(i="INT")))
    return t.inherit_number(raw, "doc_id", "raw_no").drop("raw_no")


@query("inherit_number", f"WITH {NUMBERED} SELECT * FROM num")
def _(spark, d):
    return _numbered(spark, d)


@query("section_units", f"""WITH {NUMBERED}, u AS (SELECT doc_id, number, arg_min(line, line_no) AS title, max((line_no % 6 = 5)::INT) AS is_heading,
 min(line_no) AS first_row, max(line_no) AS last_row, string_agg(line, chr(10) ORDER BY line_no) AS line FROM num GROUP BY 1, 2),
w AS (SELECT *, length(number) - length(replace(number, '.', '')) AS dots FROM u)
SELECT doc_id, number, CASE WHEN is_heading = 1 THEN title END AS heading, is_heading, first_row, last_row, md5(line) AS line,
 CASE dots WHEN 0 THEN 'SECTION' WHEN 1 THEN 'SUBSECTION' ELSE 'CLAUSE' END AS level, CASE WHEN dots > 0 THEN regexp_extract(number, '^(.*)[.][^.]*$', 1) END AS parent_number,
 array_to_string(list_transform(string_split(number, '.'), lambda s: '0/' || s::BIGINT || '/'), '.') AS sort_key,
 md5(concat_ws('|', doc_id, number, first_row)) AS unit_id FROM w""")
def _(spark, d):
    rows = _numbered(spark, d).withColumns(
        {"title": F.col("line"), "is_heading": (F.col("line_no") % 6 == 5).cast("int")}
    )
    out = t.section_units(rows, "doc_id", "number", "line", "title", "is_heading")
    return out.withColumns({"line": F.md5("line"), "sort_key": _key_text("sort_key")})


def _key_text(column):
    """A sort key spelled out, for comparison."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws("/", s["kind"], s["number"].cast("string"), s["text"])), ".")


_BULLETS = "regexp_extract_all(text, '(?im)^\\s*(?:[-*•]|\\([a-z]\\))\\s+(.*\\S)\\s*$', 1)"


@query("bullet_units", f"""WITH l AS (SELECT conv_id, turn, text, turn + 1 AS line_no, CASE WHEN turn % 3 = 0 THEN text ELSE '- ' || replace(text, chr(10), chr(10) || '- ') END AS line FROM conversations),
u AS (SELECT conv_id, CAST(line_no AS VARCHAR) AS number, line AS text, line_no AS first_row FROM l),
c AS (SELECT *, {_BULLETS} AS b FROM u),
x AS (SELECT conv_id, number, text, first_row, 1 AS is_heading, number AS heading FROM c WHERE len(b) = 0
 UNION ALL SELECT conv_id, number || '.' || unnest(range(1, len(b) + 1)), unnest(b), first_row, 0, NULL FROM c WHERE len(b) > 0)
SELECT conv_id, number, heading, is_heading, first_row, first_row AS last_row, md5(text) AS text, CASE WHEN contains(number, '.') THEN 'SUBSECTION' ELSE 'SECTION' END AS level,
 CASE WHEN contains(number, '.') THEN string_split(number, '.')[1] END AS parent_number,
 array_to_string(list_transform(string_split(number, '.'), lambda s: '0/' || s::BIGINT || '/'), '.') AS sort_key, md5(concat_ws('|', conv_id, number, first_row)) AS unit_id FROM x""")
def _(spark, d):
    bulleted = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    rows = load(spark, d, "conversations").select(
        "conv_id", (F.col("turn") + 1).alias("line_no"), (F.col("turn") + 1).cast("string").alias("number"),
        F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(bulleted).alias("text"), F.lit(1).alias("is_heading"),
    )
    units = t.section_units(rows, "conv_id", "number", "text", "number", "is_heading")
    out = t.with_bullets(units, "conv_id", "number", "text")
    return out.withColumns({"text": F.md5("text"), "sort_key": _key_text("sort_key")})


@query("split_bullets", """WITH u AS (SELECT conv_id, turn, '- ' || replace(text, chr(10), chr(10) || '- ') AS text FROM conversations),
b AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?im)^\\s*(?:[-*•]|\\([a-z]\\))\\s+(.*\\S)\\s*$', 1)) AS text,
 unnest(range(0, len(regexp_extract_all(text, '(?im)^\\s*(?:[-*•]|\\([a-z]\\))\\s+(.*\\S)\\s*$', 1)))) AS i FROM u)
SELECT conv_id, turn::VARCHAR AS parent_number, turn || '.' || (i + 1) AS number, text FROM b""")
def _(spark, d):
    u = load(spark, d, "conversations").select(
        "conv_id", F.col("turn").cast("string").alias("number"),
        F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- "))).alias("text"),
    )
    return t.split_bullets(u, "conv_id", "number", "text")


@query("split_enumerations", """WITH m AS (SELECT doc_id, string_split_regex(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\s*([0-9]+[).\\-]\\s)', chr(1) || '\\1', 'g'), '[' || chr(10) || chr(1) || ']+') AS parts FROM documents),
i AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(regexp_replace(trim(p), '^[0-9]+[).\\-]\\s*', ''))), lambda p: p <> '') AS items FROM m)
SELECT doc_id, unnest(items) AS item, CAST(unnest(range(1, len(items) + 1)) AS INTEGER) AS item_no FROM i""")
def _(spark, d):
    return t.split_enumerations(load(spark, d, "documents"), "doc_id", "text")


@query("section_rollup", f"""WITH {NUMBERED}, k AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM num WHERE starts_with(number, '2')),
b AS (SELECT doc_id, line_no, CASE WHEN prev IS NULL OR prev <> number THEN trim(concat_ws(' ', number, line)) || chr(10) ELSE '' END || trim(line) AS text FROM k)
SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS line FROM b GROUP BY 1""")
def _(spark, d):
    rows = _numbered(spark, d).withColumn("title", F.col("line"))
    return t.section_rollup(rows, "doc_id", "number", "2", "title", "line")


@query("chunk_documents", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 10 - 1, 0) + 1, 50)) AS s FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(s // 50 AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start, array_to_string(ws[s + 1:s + 60], ' ') AS chunk FROM c""")
def _(spark, d):
    return t.chunk_documents(load(spark, d, "documents"), "doc_id", "text", 60, 10)


@query("chunk_documents_chars", """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 51, 0) + 1, 350)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(s // 350 AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start, substring(text, s + 1, 400) AS chunk FROM c""")
def _(spark, d):
    return t.chunk_documents(load(spark, d, "documents"), "doc_id", "text", 400, 50, unit="char")


@query("low_value_filter", f"""WITH {SQL_LINES}, l AS (SELECT *, lower(trim(line)) AS s FROM (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 0 THEN 'It must be known ' || line ELSE line END AS line FROM lines))
SELECT doc_id, line_no, contains(s, 'this control requirement') OR contains(s, 'the control requirement') OR (regexp_matches(s, '\\bmust be (known|communicated)\\b')
 AND NOT contains(s, 'procedure') AND NOT contains(s, 'policy')) OR len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) < 5 AS is_low_value FROM l""")
def _(spark, d):
    rows = _lines(spark, d).withColumn(
        "line", F.expr("CASE WHEN line_no % 7 = 0 THEN concat('It must be known ', line) ELSE line END")
    )
    return t.low_value_filter(rows, "line").drop("line")


def _pii_sql():
    """Positions as running sums over the pieces between the matches; touching matches joined."""
    parts = []
    for k, (label, pattern) in enumerate(t.PII_PATTERNS.items()):
        p = pattern.replace("'", "''")
        parts.append(f"SELECT r, doc_id, {k} AS k, '{label}' AS label, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS hit,"
                     f" generate_subscripts(string_split_regex(text, '{p}'), 1) AS i FROM d")
    return f"""d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
 m AS ({' UNION ALL '.join(parts)}),
 pos AS (SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM m WINDOW w AS (PARTITION BY r, k ORDER BY i)),
 hits AS (SELECT *, s + length(hit) AS e FROM pos WHERE hit IS NOT NULL),
 island AS (SELECT *, sum(CASE WHEN i > 1 AND length(gap) = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY r, k ORDER BY i) AS g FROM hits),
 spans AS (SELECT r, doc_id, k, label, CAST(min(s) AS INTEGER) AS "start", CAST(max(e) AS INTEGER) AS "end" FROM island GROUP BY r, doc_id, k, label, g),
 told AS (SELECT doc_id, label, "start", "end", substring(text, "start" + 1, "end" - "start") AS value,
  substring(text, greatest("start" - 40, 0) + 1, "end" + 40 - greatest("start" - 40, 0)) AS context FROM spans JOIN d USING (r, doc_id))"""


@query("scan_pii", f"WITH {_pii_sql()} SELECT * FROM told")
def _(spark, d):
    return t.scan_pii(load(spark, d, "documents"), "doc_id", "text")["spans"]


@query("scan_pii_redacted", f"""WITH {_pii_sql()},
 o AS (SELECT *, coalesce(max("end") OVER (PARTITION BY r ORDER BY "start", "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM spans),
 c AS (SELECT r, label, "start", upto FROM o WHERE "start" >= upto),
 j AS (SELECT r, string_agg(substring(text, upto + 1, "start" - upto) || '[REDACTED_' || label || ']', '' ORDER BY "start") AS head FROM c JOIN d USING (r) GROUP BY r),
 z AS (SELECT r, max("end") AS z FROM spans GROUP BY r)
SELECT doc_id, md5(CASE WHEN head IS NULL THEN text ELSE head || substring(text, z + 1) END) AS redacted FROM d LEFT JOIN j USING (r) LEFT JOIN z USING (r)""")
def _(spark, d):
    out = t.scan_pii(load(spark, d, "documents"), "doc_id", "text")["redacted"]
    return out.withColumn("redacted", F.md5("redacted"))


@query("scan_pii_summary", f"WITH {_pii_sql()} SELECT label, count(*) AS spans, count(DISTINCT doc_id) AS documents, min(context) AS example FROM told GROUP BY 1")
def _(spark, d):
    return t.scan_pii(load(spark, d, "documents"), "doc_id", "text")["summary"]


# --- answers and prompts ----------------------------------------------------------------------

ANSWER = "concat('ANSWER: <think>', role, {nl}, '</think> **', role, '** said  *this*: ', text)"


@query("clean_answer_text", f"""WITH a AS (SELECT conv_id, turn, {ANSWER.format(nl="chr(10)")} AS x FROM conversations),
b AS (SELECT conv_id, turn, trim(regexp_replace(x, '<think>.*?</think>', '', 'gs')) AS x FROM a),
c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^(RESPONSE|ANSWER):\\s*', '', 'i'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '\\s+', ' ', 'g')) AS x FROM b),
h AS (SELECT *, left(x, 200) AS head FROM c), s AS (SELECT *, length(head) - instr(reverse(head), '.') + 1 AS stop FROM h)
SELECT conv_id, turn, x AS clean, CASE WHEN length(x) > 200 THEN CASE WHEN contains(head, '.') AND stop > 101 THEN left(head, stop) ELSE head END || ' …' ELSE x END AS short FROM s""")
def _(spark, d):
    x = F.expr(ANSWER.format(nl="'\\n'"))
    return load(spark, d, "conversations").select(
        "conv_id", "turn", t.clean_answer_text(x).alias("clean"), t.clean_answer_text(x, max_chars=200).alias("short")
    )


@query("assemble_prompts", """WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn FROM conversations),
g AS (SELECT conv_id, string_agg(i || ') ' || text, chr(10) ORDER BY turn) AS items FROM n GROUP BY 1),
f AS (SELECT conv_id, role, min(turn) AS k FROM conversations GROUP BY 1, 2), c AS (SELECT conv_id, string_agg(role, chr(10) ORDER BY k) AS ctx FROM f GROUP BY 1)
SELECT conv_id, variant, 'Write as ' || variant || ':' || chr(10) || items || chr(10) || 'Roles: ' || ctx AS prompt FROM g JOIN c USING (conv_id), (VALUES ('research'), ('marketing')) v(variant)""")
def _(spark, d):
    rows = load(spark, d, "conversations")
    template = "Write as {variant}:\n{items}\nRoles: {context}"
    return t.assemble_prompts(rows, ["conv_id"], "text", ["turn"], template, ["research", "marketing"], "role")


@query("fan_out_unique", """SELECT doc_id, m AS model, length(text) AS score FROM documents, (VALUES ('small'), ('large')) v(m)""")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    work = t.fan_out_unique(docs, "text", "doc_id", ["small", "large"])
    results = work.withColumn("score", F.length("text").cast("long"))
    return t.fan_in_results(docs, results, "text", "doc_id", ["score"])


# --- pairs ------------------------------------------------------------------------------------


def _pairs(spark, d):
    c = load(spark, d, "conversations").withColumn("exchange", F.expr("turn div 2"))
    u, a = (c.filter(F.col("role") == r).select("conv_id", "exchange", F.col("text").alias(n)) for r, n in (("user", "gold"), ("assistant", "answer")))
    return u.join(a, ["conv_id", "exchange"])


SQL_PAIRS = """pr AS (SELECT a.conv_id, a.exchange, a.text AS gold, b.text AS answer FROM (SELECT *, turn // 2 AS exchange FROM conversations WHERE role = 'user') a
 JOIN (SELECT *, turn // 2 AS exchange FROM conversations WHERE role = 'assistant') b USING (conv_id, exchange))"""
_STOP = "['the', 'and', 'of']"


def _bag(c):
    return f"list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') AND NOT list_contains({_STOP}, w)))"


def _kw(c):
    return f"len(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower({c}), '[^\\x00-\\x7F]', 'zqz', 'g'), '\\b[a-zA-Z][a-zA-Z0-9_-]*\\b'), lambda w: length(w) >= 3 AND NOT contains(w, 'zqz') AND NOT list_contains({p.KEYWORD_STOP}, w))))"


def _nw(c):
    return f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


@query("text_pair_scores", f"""WITH {SQL_PAIRS}, x AS (SELECT *, {_bag('gold')} AS bg, {_bag('answer')} AS ba, {_kw('gold')} AS kg, {_kw('answer')} AS ka, {_nw('gold')} AS ng, {_nw('answer')} AS na FROM pr)
SELECT conv_id, exchange, round(coalesce(least(ng, na)::DOUBLE / nullif(greatest(ng, na), 0), 0), 6) AS length_ratio,
 round(coalesce(len(list_intersect(bg, ba))::DOUBLE / nullif(len(list_distinct(list_concat(bg, ba))), 0), 0), 6) AS jaccard,
 round(CASE WHEN kg = 0 THEN 1 ELSE greatest(1 - abs(kg - ka)::DOUBLE / kg, 0) END, 6) AS keyword_score FROM x""")
def _(spark, d):
    out = p.text_pair_scores(_pairs(spark, d), "gold", "answer", ["the", "and", "of"])
    cols = ["length_ratio", "jaccard", "keyword_score"]
    return rounded(out.select("conv_id", "exchange", *cols), *cols, places=6)


@query("rouge_l")
def _(spark, d):
    return p.rouge_l(_pairs(spark, d), "gold", "answer").select("conv_id", "exchange", F.round("rouge_l", 6).alias("rouge_l"))


_TOKENS = p.BLEU_TOKEN.replace("\\x85", "\\x{85}")


def _bleu_sql():
    sides = " UNION ALL ".join(
        f"SELECT i, '{s}' AS side, {n} AS n, unnest(list_transform(range(1, greatest(len({s}) - {n} + 2, 1)), lambda k: array_to_string({s}[k:k + {n - 1}], ' '))) AS g FROM tok"
        for s in ("x", "y") for n in range(1, 5)
    )
    return f"""WITH {SQL_PAIRS}, tok AS (SELECT row_number() OVER () AS i, conv_id, exchange, regexp_extract_all(gold, '{_TOKENS}') AS x, regexp_extract_all(answer, '{_TOKENS}') AS y FROM pr),
 g AS (SELECT i, side, n, g, count(*) AS c FROM ({sides}) GROUP BY ALL),
 h AS (SELECT y.i, y.n, sum(y.c) AS total, sum(least(y.c, coalesce(x.c, 0))) AS hit FROM (FROM g WHERE side = 'y') y LEFT JOIN (FROM g WHERE side = 'x') x ON x.i = y.i AND x.n = y.n AND x.g = y.g GROUP BY 1, 2),
 s AS (SELECT i, count(*) FILTER (hit > 0) AS orders, sum(CASE WHEN hit > 0 THEN ln(hit::DOUBLE / total) / 4 END) AS logs FROM h GROUP BY 1)
SELECT conv_id, exchange, round(CASE WHEN orders = 4 THEN exp(logs + least(0, 1 - len(x)::DOUBLE / len(y))) ELSE 0 END, 6) AS bleu FROM tok LEFT JOIN s USING (i)"""


@query("bleu", _bleu_sql())
def _(spark, d):
    return p.bleu(_pairs(spark, d), "gold", "answer").select("conv_id", "exchange", F.round("bleu", 6).alias("bleu"))


@query("composite_score", """WITH x AS (SELECT event_id, least(value / 150, 1) AS a, least(user_id / 150.0::DOUBLE, 1) AS b FROM events),
y AS (SELECT event_id, 0.25 * a + 0.75 * b AS coverage, 0.4 * a + 0.6 * b AS sem, b AS surface FROM x)
SELECT event_id, round(coverage, 6) AS coverage, round(sem, 6) AS sem, round(1 / (0.35 / greatest(coverage, 1e-8) + 0.45 / greatest(sem, 1e-8) + 0.2 / greatest(surface, 1e-8)), 6) AS score FROM y""")
def _(spark, d):
    x = load(spark, d, "events").select(
        "event_id", F.least(F.col("value") / 150, F.lit(1.0)).alias("a"), F.least(F.col("user_id") / 150.0, F.lit(1.0)).alias("b")
    )
    pillars = {"coverage": {"a": 0.25, "b": 0.75}, "sem": {"a": 0.4, "b": 0.6}, "surface": {"b": 1.0}}
    out = p.composite_score(x, pillars, {"coverage": 0.35, "sem": 0.45, "surface": 0.2}, "score")
    return rounded(out.select("event_id", "coverage", "sem", "score"), "coverage", "sem", "score", places=6)


@query("score_by_group", """SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median FROM conversations GROUP BY 1""")
def _(spark, d):
    c = load(spark, d, "conversations").withColumn("len", F.length("text"))
    return rounded(p.score_by_group(c, ["role"], "len"), "mean", "median", places=6)


@query("preference_pairs", """WITH v AS (SELECT conv_id, turn // 2 AS exchange, role, text, least(length(text) / 600.0::DOUBLE, 1) AS sem, (length(text) % 97) / 97.0::DOUBLE AS surf FROM conversations),
j AS (SELECT a.conv_id, a.exchange, a.text AS ta, b.text AS tb, a.sem AS sa, b.sem AS sb, a.surf AS fa, b.surf AS fb FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.exchange = b.exchange AND a.role = 'user' AND b.role = 'assistant'),
m AS (SELECT avg(sa) AS m1, avg(sb) AS m2, avg(fa) AS m3, avg(fb) AS m4, stddev_samp(sa) AS d1, stddev_samp(sb) AS d2, stddev_samp(fa) AS d3, stddev_samp(fb) AS d4 FROM j),
z AS (SELECT *, (sa - m1) / d1 * 0.8 + (fa - m3) / d3 * 0.2 AS xa, (sb - m2) / d2 * 0.8 + (fb - m4) / d4 * 0.2 AS xb, (sb - m2) / d2 - (sa - m1) / d1 AS dz FROM j, m)
SELECT conv_id, exchange, md5(CASE WHEN xa > xb THEN ta ELSE tb END) AS chosen, md5(CASE WHEN xa > xb THEN tb ELSE ta END) AS rejected, round(xb - xa, 6) AS delta FROM z
WHERE greatest(sa, sb) >= 0.35 AND greatest(xa, xb) >= -0.5 AND abs(xb - xa) >= 0.08 AND sign(dz) = sign(xb - xa)""")
def _(spark, d):
    v = load(spark, d, "conversations").select(
        "conv_id", F.expr("turn div 2").alias("exchange"), "role", F.col("text").alias("answer"), F.lit("prompt").alias("prompt"),
        F.least(F.length("text") / 600.0, F.lit(1.0)).alias("sem"), (F.length("text") % 97 / 97.0).alias("surf"),
    )
    a, b = (v.filter(F.col("role") == r).drop("role") for r in ("user", "assistant"))
    out = p.preference_pairs(a, b, ["conv_id", "exchange"], "prompt", "answer", "sem", "surf")
    return out.select("conv_id", "exchange", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), F.round("delta", 6).alias("delta"))
