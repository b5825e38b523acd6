"""A corpus pipeline of four operators: language, quality, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again for the next one.  All but the last return the columns of
the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import language_id, near_dedup, packing, quality
from ferrule.llm.queries import CAPACITY, PACK_END, WORD_VOCABULARY
from ferrule.llm.scratch import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or whose language is not told apart, go."""
    return language_id.identified(docs, language_id.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely bad than good, given text and site, go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_documents(docs, quality.train(docs, labels), F.col("source"), F.col("lang"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return near_dedup.deduplicated(docs, width=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY), PACK_END, CAPACITY)


STAGES = [("language_id", known_language), ("quality", good_quality), ("near_dedup", without_near_copies), ("packing", packed)]
#: The stages learn models and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
