"""Corpus pipeline: toxicity, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, every column as it came (texts masked by the secret stage apart), whatever
other columns there are and whatever their names.

Defined results, for all stages: null texts count as empty and stay null; null doc_ids stay null and come after all others where
one row of a group stays; rows equal in doc_id and text are copies like others; empty tables give empty tables with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mailgrain.llm import exact_dedup, ngram_join, secret_scan, toxicity
from mailgrain.llm.common import release, scratch, shared_dir, table
from mailgrain.llm.packing import pack_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more go; the model is trained on the labelled rows of the stage's own input.

    Null and empty texts have no features and score as the bias alone, repeated rows alike; without labelled rows all rows stay.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal normalised text, that with the smallest doc_id stays, then that with the smallest raw text; all empty texts are one group."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked at a similarity of 0.8 or more, the row with the smallest doc_id stays.

    A text of one to four words is one shingle; a text without words is compared as a whole.
    """
    return ngram_join.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; the characters of secrets are masked, and n_chars follows. Texts without secrets, null and empty ones too, stay as they are."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is kept, packed into sequences. A null or empty text is its end id alone."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the learned scores nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):  # what the stage's operators write goes once its own result is stored
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
