"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again, and all but the last return
the columns of `documents`. See README.md for the parameters.

Nulls: a null text is an empty one in every stage, and stays null up to the mix, which takes no words of it; a null doc_id, source or other
column stays. Rows without a doc_id are never near-duplicates of others. Very long texts go whole through all stages. Repeated
rows are near-duplicates, of which one stays. Of equal documents the least doc_id stays. An empty table gives an empty result in every
stage. Further columns are kept up to the last stage, also where their names are those that a stage uses itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import mixing, packing, quality_rules, similar_texts, surrogates
from heliograph.llm.shared import new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return similar_texts.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    return surrogates.replace_personal_data(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their weights; a document comes as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: Fitting, fingerprints and tokens can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := new_folder(spark, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
