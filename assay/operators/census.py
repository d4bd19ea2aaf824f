"""Censuses, reconciliation, sampling and set tests over tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import ratio


def truth_table(rows: DataFrame, oracles: list[str]) -> DataFrame:
    """Rows by the combination of several Booleans; null counts as false."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in oracles]
    return rows.groupBy(*flags).agg(F.count("*").alias("n"))


def budget_sweep(outcomes: DataFrame, budget: str, outcome: str) -> DataFrame:
    """(budget, caught, agrees, verdicts, catch_rate)."""
    n = outcomes.groupBy(budget).agg(F.count_if(F.col(outcome) == "caught").alias("caught"), F.count_if(F.col(outcome) == "agrees").alias("agrees"))
    verdicts = F.col("caught") + F.col("agrees")
    return n.withColumn("verdicts", verdicts).withColumn("catch_rate", ratio(F.col("caught"), F.col("verdicts")))


def reconcile(rows: DataFrame, group: str, part: str, size: str, stated: DataFrame, total: str) -> DataFrame:
    """(group, parts, total, holds): the parts of each group against its stated total; null on a side does not hold."""
    parts = rows.groupBy(group).agg(F.sum(size).alias("parts"))
    both = parts.join(stated.select(group, F.col(total).alias("total")), group, "full")
    return both.withColumn("holds", F.coalesce(F.col("parts") == F.col("total"), F.lit(False)))


def gate_coverage(rows: DataFrame, gates: list[str]) -> DataFrame:
    """(gate, passed, failed, unverified, absent): how often each gate could speak; one pass, columns stacked."""
    wide = rows.agg(*[F.count_if(F.col(g) == s).alias(f"{g}_{s}") for g in gates for s in ("pass", "fail", "unverified")], *[F.count_if(F.col(g).isNull()).alias(f"{g}_null") for g in gates])
    one = [F.struct(F.lit(g).alias("gate"), F.col(f"{g}_pass").alias("passed"), F.col(f"{g}_fail").alias("failed"), F.col(f"{g}_unverified").alias("unverified"), F.col(f"{g}_null").alias("absent")) for g in gates]
    return wide.select(F.explode(F.array(*one)).alias("x")).select("x.*")


def node_agreement(left: DataFrame, right: DataFrame, node: str, flag: str) -> DataFrame:
    """One row: common nodes and the share on which two flags agree; null without common nodes."""
    both = left.select(node, F.col(flag).alias("a")).join(right.select(node, F.col(flag).alias("b")), node)
    return both.agg(F.count("*").alias("common"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def difficulty(importing: Column) -> Column:
    """The tier of a removal by the files, without tests, that import the package."""
    return F.when(importing == 0, "indirect").when(importing <= 2, "narrow").when(importing <= 4, "medium").when(importing >= 5, "wide")


def argmax(rows: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """(key, label): the label of the largest value; ties go to the smallest label."""
    return rows.groupBy(key).agg(F.min_by(label, F.struct(-F.col(value), F.col(label))).alias(label))


def step_difference(rows: DataFrame, key: str, order: str, value: str, name: str = "lost") -> DataFrame:
    """rows with value of the step before minus this one's; null at the first step."""
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(order)) - F.col(value))


def first_occurrences(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each distinct keys, by order; null is a key like others."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def quota_sample(rows: DataFrame, stratum: str, key: str, quota: dict[str, int], n: int, seed: int) -> DataFrame:
    """Fixed quotas of some strata, the rest of n from all others pooled; order is a hash of seed and key, so a sample doesn't
    depend on partitions. key is unique."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    group = F.when(F.col(stratum).isin(*quota), F.col(stratum))
    ranked = rows.withColumn("__g", group).withColumn("__h", hashed)
    limit = F.coalesce(*[F.when(F.col("__g") == s, F.lit(q)) for s, q in quota.items()])
    own = ranked.where("__g IS NOT NULL").withColumn("__n", F.row_number().over(Window.partitionBy("__g").orderBy("__h", key))).where(F.col("__n") <= limit).drop("__n")
    taken = own.count()
    rest = ranked.where("__g IS NULL").orderBy("__h", key).limit(max(0, n - taken))  # a distributed top-k
    return own.unionByName(rest).drop("__g", "__h")


def shards(n: Column, count: int, index: Column) -> tuple[Column, Column]:
    """[low, high) of a shard of n rows in `count` contiguous blocks of ceil(n / count)."""
    size = F.ceil(n / count)
    return F.least(n, index * size).cast("long"), F.least(n, (index + 1) * size).cast("long")


def set_tests(rows: DataFrame, key: str, before: str, after: str, target: Column) -> DataFrame:
    """(key, subset, shrunk, equal) of two arrays taken as sets: is after within before without the target; is it exactly
    that; are both equal? Null arrays give null."""
    rest = F.array_remove(F.array_distinct(before), target)
    extra, gone = F.array_except(after, rest), F.array_except(rest, after)
    return rows.select(key, (F.size(extra) == 0).alias("subset"), ((F.size(extra) == 0) & (F.size(gone) == 0)).alias("shrunk"), (F.array_sort(F.array_distinct(before)) == F.array_sort(F.array_distinct(after))).alias("equal"))


def leave_one_out(rows: DataFrame, key: str, items: str) -> DataFrame:
    """(key, left_out, rest): a row for each different item, with the items that stay."""
    return rows.select(key, items, F.explode(F.array_distinct(items)).alias("left_out")).select(key, "left_out", F.array_remove(items, F.col("left_out")).alias("rest"))


def affix_join(pairs: DataFrame, ids: DataFrame, first: str, last: str, composite: str) -> DataFrame:
    """pairs with the smallest composite id whose first and last part, between __, are theirs: an equi-join on the parts."""
    parts = ids.select(F.split_part(composite, F.lit("__"), F.lit(1)).alias(first), F.split_part(composite, F.lit("__"), F.lit(-1)).alias(last), F.col(composite)).groupBy(first, last).agg(F.min(composite).alias(composite))
    return pairs.join(parts, [first, last], "left")


def mention_join(variants: DataFrame, files: DataFrame, key: str, variant: str, path: str, text: str) -> DataFrame:
    """(key, path): files in which a spelling of the key stands as a word of its own. Files and spellings become lower-case
    runs of letters and digits; a spelling of several runs is met by its first one and then looked for in the text."""
    clean = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", " "), F.lit(" "))
    first = lambda c: F.regexp_extract(F.lower(c), "[a-z0-9]+", 0)
    words = files.select(path, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))).alias("w"))
    met = variants.select(key, variant, first(variant).alias("w")).distinct().join(words, "w")
    # only files that were met are cleaned, which costs far more than finding words
    inside = met.join(files.select(path, text), path).withColumn("clean", clean(text))
    alone = F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(F.lower(variant), r"([^a-z0-9])", r"\\$1"), F.lit("(?![a-z0-9])"))
    return inside.where(F.regexp_like("clean", alone)).select(key, path).distinct()


def alias_join(rows: DataFrame, aliases: DataFrame, name: str, names: str, table: DataFrame, alias: str) -> DataFrame:
    """rows joined with table on any of the import names that aliases(name, names) lists for a package, or on its own name."""
    own = rows.join(aliases.select(name, names), name, "left")
    every = F.array_distinct(F.concat(F.array(F.lower(name)), F.coalesce(names, F.expr("cast(array() AS array<string>)"))))
    return own.withColumn(alias, F.explode(every)).drop(names).join(table, alias)


def nearest_anchor(points: DataFrame, anchors: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """points(key, at, ...) with the value of the nearest anchor(key, at, value) on either side; ties go to the one before.
    One union and two windows, no range join."""
    p = points.select(key, at, F.lit(1).alias("__is"), F.lit(None).cast(anchors.schema[value].dataType).alias(value), F.struct(*points.columns).alias("__row"))
    a = anchors.select(key, at, F.lit(0).alias("__is"), value, F.lit(None).cast(p.schema["__row"].dataType).alias("__row"))
    mark = F.when(F.col("__is") == 0, F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    w = Window.partitionBy(key).orderBy(at, "__is")
    both = p.unionByName(a).withColumn("__lo", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__hi", F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    lo, hi = F.col("__lo"), F.col("__hi")
    later = lo.isNull() | (hi.isNotNull() & (hi["at"] - F.col(at) < F.col(at) - lo["at"]))
    return both.where("__is = 1").select("__row.*", F.when(later, hi["v"]).otherwise(lo["v"]).alias(value))
