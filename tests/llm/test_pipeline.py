import hashlib

import corpus_pipeline
from papyrine.llm import bpe, quality, queries, secrets


def test_stages_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "mixing_sources", "byte_level_bpe"]
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 11


def test_whole_pipeline_against_its_operators(spark):
    import public_tokenizers

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, folder).cache()
    rules = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.judged(docs, rules).where("kept").collect())
    single = corpus_pipeline.near_dedup(spark, kept, folder).cache()
    clean = corpus_pipeline.secret_scans(spark, single, folder).cache()
    texts = {r.doc_id: r.text for r in single.collect()}
    assert all(r.text == secrets.redacted(texts[r.doc_id], secrets.spans(texts[r.doc_id])) for r in clean.collect())
    mixed = corpus_pipeline.mixing_sources(spark, clean, folder).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(texts)
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    last = corpus_pipeline.byte_level_bpe(spark, mixed, folder).collect()
    now = {r.doc_id: r.text for r in clean.collect()}
    assert len(last) == mixed.count() and all(codec.decode(r.ids).decode() == now[r.doc_id] and r.n_tokens == len(r.ids) for r in last)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.n_tokens) for r in last)


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.collect()


def test_last_stage_decodes_its_own_ids(spark, odd):
    rows = corpus_pipeline.byte_level_bpe(spark, odd, "/root/testdata/sf0.001").collect()
    assert [r.decoded_sha256 for r in rows] == [hashlib.sha256((x.text or "").encode()).hexdigest() for x in odd.collect()]
