"""The corpus pipeline: rules, classifier, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Every stage works on all that the one before
it kept.  Nulls, empty texts, repeated rows and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import packing, ranking, rules, simhash, substring
from plinth.llm.common import checkpoint_folder, table
from plinth.llm.registry import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return rules.filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker keeps.

    It learns from the labelled documents of the whole table, since the rules have
    already removed most bad examples from ``docs``.
    """
    ranker = ranking.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ranking.keep_documents(docs, ranker)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that long passages of earlier texts cover."""
    return substring.strip_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents with their places in sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages are not expressible in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs)
    return docs


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder, read again."""
    path = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
