"""A training corpus from ``documents``: toxicity, quality, near-duplicates, packing.

Each stage is a function of (spark, docs, sf_dir) that judges every row its
predecessor kept; run() writes each result as Parquet to the shared folder and
reads it again as the next stage's docs. The first three return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import neardup, packing, quality, toxicity
from docsieve.llm.shared import remainder, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned on this stage's documents, does not reject."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return toxicity.keep(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts."""
    labels = table(spark, sf_dir, "labels")
    vectors = quality.word_vectors(docs)
    net = quality.train(docs, labels, remainder(F.col("doc_id"), 4) != 2, vectors)
    return quality.keep(docs, vectors, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near-duplicates; rows without an id are in no group and stay."""
    ids = neardup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct().hint("merge")
    firsts = docs.join(ids, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return firsts.unionByName(docs.where("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in windows of lexical neighbours."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Learned models and token windows have no SQL: tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
