from collections import defaultdict

import public_tokenizers

import corpus_pipeline
from plumbline.llm import packing, simhash, substrings, toxicity
from plumbline.llm.queries import QUERIES
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_simhash import alike
from tests.llm.test_substrings import brute as repeats

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = sorted((r.doc_id, r.text) for r in docs.collect() if model.at_least(r.text)[0] < toxicity.DECISION)
    assert 0 < len(clean) < docs.count()
    single = [(d, t) for (d, t), c in zip(clean, alike(clean)) if d == c]
    assert len(single) < len(clean)
    cut = []
    texts = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(single, "doc_id long, text string")).collect()}
    for (d, t), (n, lost, digest) in zip(single, repeats(single)):
        assert (texts[d].n_removed, texts[d].kept_sha256) == (lost, digest)
        cut.append((d, texts[d].text))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: t for (d, t), (_, _, hit, _) in zip(cut, leaks(cut, items)) if not hit}
    assert len(left) < len(cut)
    encoder = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["pipeline"](spark, SF).collect()
    length, filled = defaultdict(int), defaultdict(int)
    for r in rows:
        length[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert dict(length) == {d: len(encoder.encode(t or "")) // 4 + 1 for d, t in left.items()}
    assert max(filled.values()) <= 4096


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_a_group_keeps_its_smallest_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {r.component_id for r in simhash.similar_groups(docs).collect()}
