"""The operators' queries, as __spark_entry__ registers them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import warc
from .ann import nearest
from .compression import compression_rules
from .langid import language_id
from .lm import lm_scores
from .neardup import near_duplicates
from .packing import pack
from .quality import quality
from .sentencepiece_fst import round_trip
from .shared import table
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_odd_sketch_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_inverted_multi_index, op3_language_id, op4_sentencepiece_fst, op5_quality, op6_compression_bands, op7_warc_round_trip, op8_bm25_packing, op9_odd_sketch_near_dups, op10_log_bilinear_lm)}
ORACLE_SQL: dict[str, str] = {"op7_warc_round_trip": warc.ORACLE_SQL}
