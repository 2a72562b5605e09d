"""The corpus pipeline: quality, near duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.llm import bpe, jaccard, mixing, pii, quality
from groupwise.llm.common import discard, scratch, shared_folder, stored, table
from groupwise.llm.queries import BPE_PATH
from groupwise.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those here, lets pass.

    A text is scored by its own statistics, so null, empty and repeated rows are judged like
    any other; statistics of labelled documents, not their texts, meet the labels.
    """
    with scratch(spark, "quality") as folder:
        labels = table(spark, sf_dir, "labels")
        stats = stored(quality.text_statistics(docs), "stats", folder)
        train = stored(quality.training_rows(stats, labels), "train", folder)
        score = quality.text_scorer(quality.fit(train))
    return docs.where(quality.passing(score("text")) == 1)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the row with the group's least id and, among its rows, the least hash of text.

    A row counts for the group of its own text also where its id repeats. Groups that have
    only null ids keep one row as well; rows without words are all kept.
    """
    return jaccard.one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked by kind; ``n_chars`` follows."""
    masked = docs.withColumn("text", pii.redactor(pii.default_field())("text"))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the digest of what these decode to."""
    return bpe.encode(docs, BPE_PATH, decoded=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL can't express the classifier, the field or the draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(ship(spark), sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            discard(spark, f"{base}/{k - 1}")  # the stage after it has been written
    return STAGES[-1][1](spark, docs, sf_dir)
