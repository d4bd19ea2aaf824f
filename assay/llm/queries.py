"""The thin queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many licenses it holds, their names and the containments beside them."""
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    shares = F.array_join(F.transform("containments", lambda x: F.format_number(x, 4)), ",")
    return found.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"), shares.alias("containments"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of base spans; n_found counts all spans."""
    from .pii import BASE_KINDS, detect, spell

    found = detect(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(spell("base"), 256).alias("base_sha256"), spell("spans").alias("spans"), F.size("spans").cast("long").alias("n_found"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import LONG_PIECE, edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"), longest=LONG_PIECE)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled segmentations of every document, with their ids, and what they decode to, by length and checksum."""
    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), with_ids=True, with_decoded=True)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spellings import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_packing, op3_pii, op4_document_fingerprints, op5_html_extraction, op6_exact_dedup, op7_suffix_array_dedup, op8_toxicity, op9_simhash_near_dedup, op10_sentencepiece, op11_centroid_clustering, op12_spelling_variants, op13_ngram_jaccard_join)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL}
