"""Robustness statistics, sweeps, allocation, ablation and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def upper_median(values: Column) -> Column:
    """v[n // 2] of the sorted values of a small group; order_statistics() is for whole tables."""
    v = F.array_sort(F.collect_list(values))
    return F.element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int"))


def quantile_index(values: Column, q: float) -> Column:
    """v[int(q * (n - 1))] of the sorted values of a small group, which is no percentile_disc."""
    v = F.array_sort(F.collect_list(values))
    return F.element_at(v, (F.floor(F.lit(q) * (F.size(v) - 1)) + 1).cast("int"))


def order_statistics(rows: DataFrame, value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row with the values at some ranks, from 0, of the sorted values; ranks are expressions over `n`, their number.

    Values are counted first, then range-partitioned; a range's rows are numbered from the total of the ranges before it, so
    nothing but one total a range is brought together. Nulls don't count; without values every rank is null."""
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).repartitionByRange("v").withColumn("range", F.spark_partition_id()))
    totals = counts.groupBy("range").agg(F.sum("c").alias("t"))  # one row a range
    before = totals.select("range", F.coalesce(F.sum("t").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = F.sum("c").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).join(F.broadcast(before), "range").select("v", (F.col("base") + F.col("upto") - F.col("c")).alias("__low"), (F.col("base") + F.col("upto")).alias("__high"))
    asked = totals.agg(F.sum("t").alias("n")).select(*[r.cast("long").alias(name) for name, r in ranks.items()])  # one row
    met = placed.join(F.broadcast(asked), F.lit(True))
    return met.agg(*[F.max(F.when((F.col(name) >= F.col("__low")) & (F.col(name) < F.col("__high")), F.col("v"))).alias(name) for name in ranks])


def upper_median_rank() -> Column:
    """v[n // 2]."""
    return F.floor(F.col("n") / 2)


def quantile_rank(q: float) -> Column:
    """v[int(q * (n - 1))], which is no percentile_disc."""
    return F.floor(F.lit(q) * (F.col("n") - 1))


def pearson(x: str, y: str) -> Column:
    """Null with fewer than two rows or without variance."""
    return F.when((F.count("*") > 1) & (F.coalesce(F.var_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.var_pop(y), F.lit(0.0)) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def buckets(rows: DataFrame, value: str, edges: list[tuple[str, float]]) -> DataFrame:
    """Counts by the first upper edge that holds the value; empty buckets are kept, what lies above all is '>'."""
    label = F.lit(">")
    for name, high in reversed(edges):
        label = F.when(F.col(value) <= high, name).otherwise(label)
    names = rows.sparkSession.createDataFrame([(n,) for n, _ in edges] + [(">",)], "bucket string")
    counted = rows.where(F.col(value).isNotNull()).groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    return names.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def sweep(rows: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """How many values reach each threshold; one pass, thresholds are columns that are then stacked."""
    wide = rows.agg(*[F.count_if(F.col(value) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)])
    return wide.select(F.explode(pairs).alias("x")).select("x.*")


def leave_top_out(groups: DataFrame, group: str, hits: str, total: str, ks: list[int], least: int) -> DataFrame:
    """For each k: median rate and share of groups with hits, without the k groups that have most hits. Groups with fewer
    than `least` in all don't take part."""
    rate = groups.where(F.col(total) >= least).withColumn("rate", F.col(hits) / F.col(total))
    most = rate.orderBy(F.desc(hits), group).limit(max(ks)).select(group, hits)
    ranked = most.withColumn("nth", F.row_number().over(Window.orderBy(F.desc(hits), group))).select(group, "nth")  # max(ks) rows
    seen = rate.join(F.broadcast(ranked), group, "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    kept = seen.where(F.col("nth").isNull() | (F.col("nth") > F.col("k")))
    return kept.groupBy("k").agg(F.count("*").alias("groups"), F.median("rate").alias("median_rate"), F.count_if(F.col(hits) > 0).alias("affected"))


def largest_remainder(strata: DataFrame, stratum: str, size: str, n: int) -> DataFrame:
    """Quota of each stratum of n draws: floors, then the largest remainders, ties by name. strata has one row each."""
    total = strata.agg(F.sum(size).alias("total"))
    share = strata.crossJoin(F.broadcast(total)).withColumn("exact", F.lit(n) * F.col(size) / F.col("total")).withColumn("floor", F.floor("exact"))
    w = Window.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), stratum)  # one row a stratum
    missing = F.lit(n) - F.sum("floor").over(Window.partitionBy(F.lit(1)))
    return share.withColumn("nth", F.row_number().over(w)).withColumn("quota", (F.col("floor") + (F.col("nth") <= missing).cast("int")).cast("long")).select(stratum, size, "quota")


def ablation(rows: DataFrame, gates: list[str]) -> DataFrame:
    """Accepted rows by step, where step k asks the first k gates: a null status is ignored, 'pass' passes, 'fail' rejects,
    anything else withholds. What a step loses is split by the new gate's status."""
    passes = lambda g: F.col(g).isNull() | (F.col(g) == "pass")
    columns, until = [], F.lit(True)
    for k, g in enumerate(gates, 1):
        columns += [F.count_if(until & passes(g)).alias(f"a{k}"), F.count_if(until & (F.col(g) == "fail")).alias(f"r{k}"), F.count_if(until & ~passes(g) & (F.col(g) != "fail")).alias(f"w{k}")]
        until = until & passes(g)
    wide = rows.agg(*columns)
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(g).alias("gate"), F.col(f"a{k}").alias("accepted"), F.col(f"r{k}").alias("rejected"), F.col(f"w{k}").alias("withheld")) for k, g in enumerate(gates, 1)])
    return wide.select(F.explode(steps).alias("x")).select("x.*")


def overlap(rows: DataFrame, layers: list[str]) -> DataFrame:
    """Rows by the set of layers that caught them; a null layer could not speak."""
    caught = F.concat_ws("+", *[F.when(F.col(c), F.lit(c)) for c in layers])
    spoke = sum((F.col(c).isNotNull().cast("int") for c in layers), F.lit(0))
    label = F.when(caught != "", caught).when(spoke == len(layers), f"none (all {len(layers)} spoke)").otherwise(F.concat(F.lit("none ("), spoke.cast("string"), F.lit(f" of {len(layers)} could speak)")))
    return rows.groupBy(label.alias("caught_by")).agg(F.count("*").alias("n"))


def drift(stated: DataFrame, computed: DataFrame) -> DataFrame:
    """Stated against computed metrics (metric, value): equal, differs, or missing on a side."""
    both = stated.select("metric", F.col("value").alias("stated")).join(computed.select("metric", F.col("value").alias("computed")), "metric", "full")
    state = F.when(F.col("stated").isNull(), "not stated").when(F.col("computed").isNull(), "not computed").when(F.col("stated") == F.col("computed"), "equal").otherwise("differs")
    return both.withColumn("state", state)


def verdict(statuses: list[Column]) -> Column:
    """Tri-state: 'rejected' if a gate fails, else 'withheld' if one can't speak, else 'accepted'; null gates are absent."""
    fails = [F.coalesce(s == "fail", F.lit(False)) for s in statuses]
    opens = [F.coalesce(s != "pass", F.lit(False)) for s in statuses]
    any_of = lambda cs: F.greatest(*[c.cast("int") for c in cs], F.lit(0)) > 0
    return F.when(any_of(fails), "rejected").when(any_of(opens), "withheld").otherwise("accepted")
