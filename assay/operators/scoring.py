"""Set scoring: predicted against true elements by key, micro and macro averages, agreement of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """top / bottom; `empty` where bottom is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(empty).cast("double"))


def set_scores(truth: DataFrame, predicted: DataFrame, key: str, element: str) -> DataFrame:
    """(key, tp, fp, fn) from two tables of (key, element); both sides are taken as sets."""
    t = truth.select(key, element).distinct().withColumn("t", F.lit(1))
    p = predicted.select(key, element).distinct().withColumn("p", F.lit(1))
    both = t.join(p, [key, element], "full")
    hit = lambda c: F.count_if(c).alias
    return both.groupBy(key).agg(hit(F.col("t").isNotNull() & F.col("p").isNotNull())("tp"), hit(F.col("t").isNull())("fp"), hit(F.col("p").isNull())("fn"))


def with_rates(scores: DataFrame) -> DataFrame:
    """precision, recall and f1 beside tp, fp and fn; 0 where there is nothing to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return scores.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def micro(scores: DataFrame) -> DataFrame:
    return with_rates(scores.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]))


def macro(scores: DataFrame) -> DataFrame:
    return with_rates(scores).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def transitions(first: DataFrame, second: DataFrame, key: str, verdict: str) -> DataFrame:
    """How often each pair of verdicts occurs among keys of both runs."""
    both = first.select(key, F.col(verdict).alias("before")).join(second.select(key, F.col(verdict).alias("after")), key)
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def jaccard(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """One row: shared, united and their ratio, of two sets of rows."""
    a, b = left.select(columns).distinct().withColumn("a", F.lit(1)), right.select(columns).distinct().withColumn("b", F.lit(1))
    both = a.join(b, columns, "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count("*").alias("united"))
    return both.withColumn("jaccard", F.col("shared").cast("double") / F.greatest(F.col("united"), F.lit(1)))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn of two Booleans, and rows where one abstains (null)."""
    known = predicted.isNotNull() & actual.isNotNull()
    return rows.agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
        F.count_if(~known).alias("abstained"),
    )
