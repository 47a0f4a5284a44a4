"""The pipeline against a plain version of its decisions."""

import corpus_pipeline
from test_operators import brute_groups

from docsieve.llm import quality, toxicity
from docsieve.llm.shared import remainder, stored, table
from pyspark.sql import functions as F


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    columns = docs.columns
    clean = stored(corpus_pipeline.drop_toxic(spark, docs, sf_dir), "t")
    model = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    low = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == low
    good = stored(corpus_pipeline.keep_quality(spark, clean, sf_dir), "q")
    vectors = quality.word_vectors(clean)
    net = quality.train(clean, labels, remainder(F.col("doc_id"), 4) != 2, vectors)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(clean, vectors, net).collect() if r.predicted}
    single = stored(corpus_pipeline.drop_near_duplicates(spark, good, sf_dir), "n")
    groups = brute_groups({r.doc_id: r.text for r in good.collect()})
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {g for _, g in groups.values()}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}


def test_pipeline_on_hard_rows(spark, hard, sf_dir):
    docs = hard
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "hard")
        assert docs.columns == hard.columns
    assert docs.where("doc_id IS NOT NULL").count() == docs.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
