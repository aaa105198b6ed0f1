"""Columns of a caller that bear the names of helper columns come through unchanged."""

from pyspark.sql import functions as F

from plumbline.llm import decontam, extraction, packing, simhash, substrings, toxicity
from plumbline.llm.names import free_name

SF = "/root/testdata/sf0.001"
HELPERS = ["_h", "_id", "_hb", "_doc", "_hash", "_spans", "_text", "_starts", "_lengths", "_row", "_n", "row", "spans"]


def with_helpers(df, id_col="doc_id", extra=()):
    return df.withColumns({c: F.concat(F.lit(c), F.col(id_col).cast("string")) for c in [*HELPERS, *extra]})


def unchanged(out, id_col="doc_id", extra=()):
    rows = out.select(id_col, *HELPERS, *extra).collect()
    assert rows and all(r[c] == f"{c}{r[id_col]}" for r in rows for c in [*HELPERS, *extra])


def test_free_name():
    assert free_name("_h", ["a"]) == "_h" and free_name("_h", ["_H", "__h"]) == "___h"


def test_filters_and_cuts_keep_a_callers_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items, labels = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    named = with_helpers(docs)
    key = ["doc_id", "text"]
    for step in (
        lambda d: decontam.drop_contaminated(d, items),
        lambda d: substrings.remove_repeats(d),
        lambda d: toxicity.drop_toxic(d, labels),
        lambda d: simhash.keep_one(d),
    ):
        got = step(named)
        unchanged(got)
        assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, step(docs).select(key).collect()))


def test_scores_keep_a_callers_columns(spark):
    docs = with_helpers(spark.read.parquet(f"{SF}/documents.parquet"))
    unchanged(simhash.with_fingerprint(docs))
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    unchanged(toxicity.severity(docs, model, keep_text=True))


def test_extraction_keeps_a_callers_columns(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = extraction.fit(pages)
    got = extraction.extract(with_helpers(pages, "page_id", ["_html"]), trees)
    unchanged(got, "page_id", ["_html"])
    plain = extraction.extract(pages, trees)
    assert sorted(got.select("page_id", "text").collect()) == sorted(plain.select("page_id", "text").collect())


def test_other_columns_are_ignored(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = with_helpers(docs, extra=["part", "nth", "length", "start", "piece"])
    pack = lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json"))
    cols = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(pack(named).select(cols).collect()) == sorted(pack(docs).select(cols).collect())
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    cols = ["doc_id", "n_words", "n_hit"]
    got = decontam.decontaminate(named, with_helpers(items, "item_id")).select(cols)
    assert sorted(got.collect()) == sorted(decontam.decontaminate(docs, items).select(cols).collect())
