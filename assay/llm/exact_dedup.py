"""Exact deduplication: group by a 128-bit content hash, compare the bytes inside each group, keep one stable id.

Null text is the empty text. Repeated ids with equal text are one class like any other rows; all rows that carry the
kept id are marked as kept. A null id stays only where all ids of its class are null. An empty table gives an empty result. Other columns
play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.md5(text)


def classes(rows: DataFrame, keep: str = "min") -> DataFrame:
    """One row per distinct text of rows(id, hash, text). The text itself is a grouping column, so rows whose hashes
    collide but whose bytes differ fall into different classes; copies meet map-side, so a hot text is not moved."""
    pick = F.min if keep == "min" else F.max
    return rows.groupBy("hash", "text").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size")).select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Every row of docs with its class: (id_col, keep_id, group_size, kept, text_sha256).

    A row finds its class through both hashes. That join moves ids and digests only; adaptive execution splits the
    partition of a hot text, as both its sides come straight from exchanges."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).withColumn("hash", content_hash(F.col("text")))
    own = rows.select("id", "hash", F.sha2("text", 256).alias("text_sha256"))
    found = own.join(classes(rows, keep), ["hash", "text_sha256"])
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without copies, all columns as they were: one row of each distinct text, in one shuffle whose map side
    already folds the copies that a task has read. A text moves once, as a grouping column; the kept row's other columns
    ride along, with a mark whether its text was null."""
    pick = F.min_by if keep == "min" else F.max_by
    text = text_or_empty(text_col)
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(f"`{text_col}`").isNull().alias("0"), *[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(others, 1)])
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), content_hash(text).alias("hash"), text.alias("text"))
    order = F.struct(F.col("id").isNotNull() if keep == "max" else F.col("id").isNull(), F.col("id"))
    kept = rows.groupBy("hash", "text").agg(pick("row", order).alias("row"))
    back = {c: F.col("row").getField(str(i)) for i, c in enumerate(others, 1)}
    back[text_col] = F.when(~F.col("row").getField("0"), F.col("text")).cast(docs.schema[text_col].dataType)
    return kept.select(*[back[c].alias(c) for c in docs.columns])
