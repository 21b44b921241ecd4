"""Corpus pipeline: language, repeated lines, near-duplicates, personal data, packing.

Each stage takes the documents that its predecessor kept. All but the last return the columns of documents as they
were, whatever further columns there are; the last returns the packed pieces. Models are fitted on the stage's own
input. An empty table passes through every stage and ends as an empty table of pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmatrix.llm import langid, line_dedup, minhash, packing, pii
from featmatrix.llm.common import durable


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model recognises; null texts and texts without a letter go."""
    return langid.keep_recognised(docs, langid.fit(docs))


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are cut out of the texts; documents left without a word go."""
    return line_dedup.remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Rows that repeat a doc_id with other texts are documents of their own.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & (F.unhex(F.md5("text")) == F.col("_hash"))
    return docs.join(gone, same, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """E-mail addresses, IP addresses, card and phone numbers are replaced by their kind."""
    return pii.mask(docs, pii.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens."""
    return packing.pack_examples(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("language", language),
    ("line_runs", line_runs),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Trained models, signatures and packing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result goes to the shared checkpoint folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
