"""The corpus pipeline: toxicity, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.llm import _common as common
from vectrill.llm import ngram_join, packing, quality_rules, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 1/2; learnt from labels outside the held-out fold."""
    labels = _labels(spark, sf_dir)
    model = toxicity.learn(docs, labels.where(common.fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model, score_out="_toxicity").where(F.col("_toxicity") < 0.5).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learnt decision list."""
    rules = quality_rules.learn_rules(docs, _labels(spark, sf_dir))
    measured = quality_rules.measure(docs, prefix="_q_")
    return measured.where(~quality_rules.base_failed("_q_") & quality_rules.verdict(rules, "_q_")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of similarity 0.8 or more connect: the one with the smallest id."""
    return ngram_join.one_of_each(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: Learnt models and a tokenizer are not SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
