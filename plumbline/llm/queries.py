"""The registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import codes, decontam, extraction, kdtree, licenses, packing, pii, runs, simhash, substrings, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("op6_simhash_pigeonring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    named = simhash.near_duplicates(_load(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return named.select("doc_id", digits.alias("fingerprint"), "component_id")


@_query("op9_superkmer_substrings")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document after repeated 13-word windows are cut."""
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@_query(
    "op8_prefix_decontamination",
    f"""
    with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
    b as (select item_id, {_WORDS} as w from benchmark),
    windows as (
        select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as words
        from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
    ),
    spots as (
        select r, i, size, array_to_string(w[i:i + size - 1], ' ') as words
        from (select r, w, size, unnest(generate_series(1, len(w) - size + 1)) as i
              from d, (select distinct size from windows) where len(w) >= size)
    ),
    found as (select r, i, spots.size, item_id from spots join windows using (words, size)),
    hit as (select r, count(distinct p) as n_hit from
            (select r, unnest(generate_series(i, i + size - 1)) as p from (select distinct r, i, size from found))
            group by r),
    named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
              from found group by r)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit using (r) left join named using (r)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    hits = decontam.decontaminate(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op4_bin_completion_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of at most 4096."""
    return packing.pack_documents(_load(spark, sf_dir, "documents"), _tokenizer())


@_query("op5_ordinal_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.severity(docs, toxicity.fit(docs, _load(spark, sf_dir, "labels")))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


@_query(
    "op10_three_phase_topk",
    """
    with v as (
        select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x
        from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ),
    s as (
        select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
        from v q join v c on q.vec_id % 20 = 0 and q.r <> c.r
    ),
    ranked as (
        select *, row_number() over (partition by r order by score desc, vec_id)::int as rank from s
    )
    select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth vector."""
    return topk.top_k(_load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query(
    "op2_warc_zstd",
    """
    with p as (
        select page_id, encode(coalesce(html, '')) as b from pages
    ),
    d as (select page_id, octet_length(b) as n, sha256(b) as digest from p),
    f as (select *, min(page_id) over (partition by digest) as first from d)
    select page_id, n::bigint as payload_bytes, digest as payload_digest,
           case when n >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
           case when n >= 100 and first <> page_id then first end as refers_to
    from f
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from Zstandard archives."""
    page = lambda c: F.substring_index(c, ":", -1).cast("long")
    return warc.round_trip(_load(spark, sf_dir, "pages")).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


@_query("op3_kdtree_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return kdtree.shard_documents(_load(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _license_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    row = "seq"
    for name, needed in licenses.RULES:
        row = f"replace({row}, {text(''.join(f'<{i}>' for i in needed))}, {text('{' + name + '}')})"
    known = ", ".join(f"({text(s)}, {text(i)})" for s, i in sorted(licenses.KNOWN.items()))
    mended = "twice"  # ends of lines and sentences stand twice there, so that neighbours have one each
    for pattern, line in licenses.wrapped("(?: |\n\n)").items():
        mended = f"regexp_replace({mended}, {text(f'(^|[\n|])(?:{pattern})($|[\n|])')}, {text(f'\\1{line}\\2')}, 'g')"
    return f"""
    with known(s, id) as (values {known}),
    d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
    joined as (
        select r, replace(regexp_replace(t, '\r?\n[ \t/*#;%-]*([a-z(])', ' \\1', 'g'), '|', '-') as s
        from d where regexp_matches(lower(t), '{licenses.ANCHORS}')
    ),
    cut as (select r, lower(regexp_replace(s, '[.!?]+(\\s|$)', '|', 'g')) as s from joined),
    flat as (
        select r, trim(regexp_replace(regexp_replace(regexp_replace(s, '[^a-z0-9+.|\n]+', ' ', 'g'),
                                                     '\n ?(\n ?)+', '|', 'g'), ' ?([\n|]) ?', '\\1', 'g')) as s from cut
    ),
    doubled as (select r, replace(replace(s, '|', '||'), '\n', '\n\n') as twice from flat),
    lines as (
        select r, unnest(x) as s, generate_subscripts(x, 1) as pos
        from (select r, string_split_regex({mended}, '[\n|]+') as x from doubled)
    ),
    found as (
        select r, pos, coalesce(known.id, '?') as id
        from lines left join known on lines.s = known.s
        where regexp_matches(lines.s, '{licenses.ANCHORS}')
    ),
    seqs as (
        select r, string_agg(id, ' ' order by pos) as ids, string_agg('<' || id || '>', '' order by pos) as seq
        from found where id is not null group by r
    ),
    done as (select r, ids, {row} as claimed from seqs)
    select doc_id, coalesce(ids, '') as sentence_ids,
           coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(claimed, '\\{{([^}}]*)\\}}', 1))), ','), '') as licenses,
           coalesce(len(regexp_extract_all(claimed, '<([^>]*)>', 1)), 0)::bigint as n_unclaimed
    from d left join done using (r)
    """


@_query("op1_license_sentences", _license_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.scan(_load(spark, sf_dir, "documents")).select(
        "doc_id",
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "n_unclaimed",
    )


@_query("op7_gbt_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _load(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = extraction.extract(pages, extraction.fit(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_OP11_SQL = """
    with split as (
        select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
               list_reduce([4294967295::ubigint] || list_transform(range(1, length(doc_id::varchar) + 1),
                               lambda i: ascii(substr(doc_id::varchar, i, 1))::ubigint),
                           lambda c, b: list_reduce([xor(c, b)] || range(8)::ubigint[],
                               lambda x, k: xor(x >> 1, 3988292384::ubigint * (x & 1)))) as crc
        from documents
    ),
    numbered as (
        select r, doc_id, w, len(w)::bigint as n, xor(crc, 4294967295::ubigint)::bigint as h,
               xor(crc, 4294967295::ubigint)::bigint // 10 as g from split
    ),
    places as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from numbered),
    periods as (select *, 1 + (n - a) // (3 + g % 8) as q from places),
    d as (
        select r, doc_id, n, case when a is null then w
               else list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % q end + 1]) end as w
        from periods
    ),
    words as (select r, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
    equal as (
        select x.r, y.i - x.i as p, x.i
        from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
    ),
    islands as (select r, p, i, i - row_number() over (partition by r, p order by i) as island from equal),
    stretches as (
        select r, p, min(i) as s, count(*) + p as length from islands group by r, p, island
        having count(*) + p >= greatest(6, 4 * p)
    ),
    runs as (select r, s, length, min(p) as p from stretches group by r, s, length),
    named as (
        select r, count(*) as n_runs, string_agg(s || ',' || length || ',' || p || chr(10), '' order by s, p) as lines,
               min(struct_pack(l := -length, s := s, p := p)) as top
        from runs group by r
    ),
    gone as (select distinct r, unnest(generate_series(s + p, s + length - 1)) as i from runs),
    kept as (
        select r, string_agg(word, ' ' order by i) as t from words anti join gone using (r, i) group by r
    )
    select doc_id, coalesce(n_runs, 0)::bigint as n_runs, top.s::bigint as start, (-top.l)::bigint as length,
           top.p::bigint as period, (1000 * -top.l // top.p)::bigint as exponent_milli,
           sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
    from d left join named using (r) left join kept using (r)
"""


@_query("op11_minimizer_runs", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them with a stretch that repeats."""
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    split = docs.withColumn("w", F.when(h % 10 == 0, words))  # null where the text stays as it is
    split = split.withColumns({"n": F.size("w"), "g": F.floor(h / 10)})
    split = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    split = split.withColumn("p", (F.lit(1) + F.floor(rest / (F.lit(3) + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    whole = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    asked = split.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(whole).alias("text"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return (
        runs.find_runs(asked)
        .select("doc_id", "runs", "collapsed", top.alias("top"))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("top.s")).alias("start"),
            F.col("top.l").alias("length"),
            (-F.col("top.p")).alias("period"),
            F.floor(F.lit(1000) * F.col("top.l") / -F.col("top.p")).cast("long").alias("exponent_milli"),
            F.sha2(lines, 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def _codes_sql() -> str:
    steps = ["""
    with kept as (
        select row_number() over (order by vec_id, x) as r, * from (
            select vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as x
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0)
    ),
    parts as materialized (
        select r, vec_id, label, p, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] as v
        from kept, (select unnest(range(4)) as p)
    ),
    book0 as materialized (select p, r - 1 as e, v as c from parts where r <= 256)"""]
    near = """,
    near{i} as materialized (
        select r, p, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := e)) as best
        from parts join book{i} using (p) group by r, p
    )"""
    for i in range(4):
        steps.append(near.format(i=i))
        steps.append(f""",
    sums{i} as (
        select p, e, k, floor(sum(y)::double / count(*))::bigint as y
        from (select parts.p, best.e as e, unnest(v) as y, generate_subscripts(v, 1) as k from parts join near{i} using (r, p))
        group by p, e, k
    ),
    book{i + 1} as materialized (
        select p, e, coalesce(m, c) as c
        from book{i} left join (select p, e, list(y order by k) as m from sums{i} group by p, e) using (p, e)
    )""")
    steps.append(near.format(i=4))
    steps.append(""",
    digest as (
        select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book4
    ),
    done as (
        select r, string_agg(lower(lpad(hex(best.e), 2, '0')), '' order by p) as code, sum(best.d)::bigint as error
        from near4 group by r
    )
    select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
    from done join kept using (r), digest
    """)
    return "".join(steps)


@_query("op12_norm_sum_codes", _codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, and the codebooks it refers to."""
    done = codes.product_codes(_load(spark, sf_dir, "embeddings"))
    digits = F.transform("codes", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    return codes.with_label_error(done.rows).select(
        F.col("id").alias("vec_id"),
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.lit(done.digest()).alias("codebooks_sha256"),
    )


@_query("op13_skip_chain_pii")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the spans of fixed patterns, and those that the field adds."""
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    named = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(pii.KINDS) for x in (k, i)])
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return (
        pii.find(docs, pii.fit(docs))
        .withColumn("all", F.array_sort(keyed))
        .select(
            "doc_id",
            *[counted(k).alias(f"n_{k}") for k in pii.KINDS],
            F.sha2(named("base"), 256).alias("base_sha256"),
            named("all").alias("spans"),
        )
    )
