"""The pipeline's stages take effect and keep clean documents."""

import corpus_pipeline
from helpers import links, without_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.durable(stage(spark, before, SF))
        assert after.columns == columns and after.count() > 0.5 * before.count()
        if name == "ngram_jaccard_join":
            rows = [tuple(r) for r in after.select("doc_id", "text").collect()]
            assert all(component == r[0] for r, (_, component) in zip(rows, links(rows)))
        if name == "suffix_array_dedup":
            old = [tuple(r) for r in before.select("doc_id", "text").collect()]
            changed = {r[0]: x[1] for r, x in zip(old, without_repeats(old))}
            texts = {r[0]: r[1] for r in old}
            for r in after.collect():
                assert r.n_chars == len(r.text) and (changed[r.doc_id] > 0 or r.text == texts[r.doc_id])
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
