"""Corpus pipeline: from raw documents to packed training sequences.

Five stages run one after another, each over all that its predecessor kept. Every stage's result is written as
Parquet to the shared folder and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import jaccard_join, packing, pii, quality_classifier, quality_rules
from lodestar.llm.common import Scratch, fold


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier scores 0.5 or more."""
    return quality_classifier.keep_good(docs, _labels(spark, sf_dir), fold("doc_id", 3) != 1)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base test and the learned rules."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; n_chars follows."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the texts into pieces of ids and pack these, ids included, into sequences of 4096."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("jaccard_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the learned rules, the masking or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.release(name)
    return docs
