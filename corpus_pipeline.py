"""The corpus pipeline: quality rules, exact and near duplicates, personal data, packing.

Each stage takes what the last one kept. All but the last return the columns of documents; the last returns the
pieces of the training sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmill.functions.checkpointing import ensure_checkpoint_dir
from corpusmill.llm import exact_dedup, near_dedup, packing, personal_data, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go, the missing and empty texts among them.

    Whole texts of any length are read. A missing doc_id is carried along; repeated rows share a verdict; an empty table
    stays empty; columns of any name stay as they are.
    """
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a missing text is an empty one, a missing doc_id the smallest.

    Of rows that repeat id and text one stays. Texts of any length are compared whole; an empty table stays empty; columns
    of any name stay as they are.
    """
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest doc_id stays.

    Texts without words, and rows without doc_id, are linked with nothing and stay; rows that share the doc_id that stays
    all stay. Shorter texts are one shingle. An empty table stays empty; columns of any name stay as they are.
    """
    return near_dedup.keep_one(docs, near_dedup.Settings(words=5, percent=80))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; no document goes.

    A missing text stays missing; repeated rows are masked alike; texts of any length are read whole; an empty table stays
    empty; columns of any name stay as they are.
    """
    return personal_data.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; a missing or empty text has the end id only, repeated rows are packed as often.

    An empty table has no pieces. Of very long texts whole sequences go out as they are read. Workers share an executor
    with what earlier stages have left in its memory, so they remember less than they could.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=250_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("personal_data", personal_data_masked),
    ("packing", packed),
]

#: Expectation-maximisation, pattern bootstrapping and tokenisers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
