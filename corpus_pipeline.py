"""The corpus pipeline: toxic documents go, copies go, one of each near-duplicate group stays, personal data is masked,
and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it again as
the next stage's docs, so a later stage never recomputes an earlier one and a lost executor loses nothing.

Null texts count as empty ones: all but one go as copies of each other. Null ids sort after others, so such rows go first
where one of several stays; repeated rows are copies; of ties in id and text any one row stays. An empty table gives an
empty result. Columns beside doc_id, text and n_chars pass through as they are, whatever their names, up to packing.
"""

from __future__ import annotations

import uuid

from assay.llm import exact_dedup, packing, pii, simhash, toxicity
from assay.llm.common import shared_folder, table
from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects. It learns from the whole documents table and its labels."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Training a classifier and packing by a linear program can't be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
