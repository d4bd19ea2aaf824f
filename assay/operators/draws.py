"""Capped greedy draws of (repository, dependency) pairs, over candidates cut by rules that no pick can escape.

A draw is n dependent steps, so its last part is one task; what reaches it has a size that n, the bands and the strata
bound, however large the pool is. Each rule leaves out a pair only where a strictly better one that can be picked is sure
to stand beside it at every step, so the draw is that of the whole pool:

* A: a pair behind n + 1 others of its dependency in repository order (stratum and band alike): one of their repositories
  hasn't been drawn, so that pair comes first.
* B: the same with repository and dependency exchanged.
* C: a pair behind 4n(n + 1) others of its stratum and band: since each repository and dependency has at most n + 1 of
  those, 2n + 1 of them share neither, and one of these has both undrawn.

Rows with a null stratum, repository or dependency don't take part; repeated rows count once, and of a pair with several
footprints the smallest stays. An empty pool gives an empty draw.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut, parts


def _pool(pool: DataFrame, stratum: str, repo: str, dep: str, footprint: Column, band: Column) -> DataFrame:
    named = pool.select(F.col(stratum).alias("s"), F.col(repo).alias("r"), F.col(dep).alias("d"), footprint.alias("f"), band.alias("b"))
    named = named.where("s IS NOT NULL AND r IS NOT NULL AND d IS NOT NULL")
    dealt = named.repartition(parts(named.sparkSession, named.count()), "r", "d")
    return cut(dealt.groupBy("s", "r", "d").agg(F.min(F.struct("f", "b")).alias("x")).select("s", "r", "d", "x.f", "x.b"))


def _first(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def _candidates(rows: DataFrame, n: int) -> DataFrame:
    """Rule C goes bucket by bucket, eight into one, so no task sees more than eight buckets' firsts of a stratum and band."""
    buckets, most = parts(rows.sparkSession, rows.count()), 4 * n * (n + 1) + 1
    by_dep = _first(rows.repartition(buckets, "s", "b", "d"), ["s", "b", "d"], ["r"], n + 1)
    dealt = by_dep.withColumn("bucket", F.pmod(F.xxhash64("r"), F.lit(buckets)).cast("int")).repartitionById(buckets, F.col("bucket"))
    by_repo = _first(dealt, ["s", "b", "r", "bucket"], ["d"], n + 1)
    first = _first(by_repo, ["s", "b", "bucket"], ["r", "d"], most)
    while buckets > 1:
        buckets = math.ceil(buckets / 8)
        first = first.withColumn("bucket", F.col("bucket") % buckets).repartition(32 * buckets, "s", "b", "bucket")
        first = _first(first, ["s", "b", "bucket"], ["r", "d"], most)
    return first.drop("bucket")


def _quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Largest remainders, ties by name."""
    total = sum(sizes.values())
    out = {s: n * v // total for s, v in sizes.items()}
    for s in sorted(sizes, key=lambda s: (-(n * sizes[s] % total), s))[: n - sum(out.values())]:
        out[s] += 1
    return out


def _steps(t: pd.DataFrame, quota: Callable[[dict[str, int]], dict[str, int]], per_repo: int, per_dep: int, budget: int) -> list[tuple]:
    repos, deps, out = Counter(), Counter(), []
    sizes = dict(zip(t["s"], t["size"], strict=True))
    wanted = quota(sizes)
    for s in sorted(sizes, key=lambda s: (sizes[s], s)):
        rows = t[t["s"] == s]
        target = {b: c / sizes[s] for b, c in zip(rows["b"], rows["band_size"], strict=True)}
        left = list(zip(rows["r"], rows["d"], rows["f"], rows["b"], strict=True))
        got: Counter = Counter()
        for taken in range(min(wanted.get(s, 0), budget - len(out))):
            fit = [c for c in left if repos[c[0]] < per_repo and deps[c[1]] < per_dep]
            if not fit:
                break
            pick = min(fit, key=lambda c: (repos[c[0]], deps[c[1]], got[c[3]] - target[c[3]] * (taken + 1), c[0], c[1]))
            left.remove(pick)
            repos[pick[0]] += 1
            deps[pick[1]] += 1
            got[pick[3]] += 1
            out.append((s, *pick[:3], len(out) + 1, False))
        if len(out) >= budget:
            break
    return out


_DRAWN = "s string, r string, d string, f long, nth int, filled boolean"


def _drawn(rows: DataFrame, quota: Callable[[dict[str, int]], dict[str, int]], per_repo: int, per_dep: int, budget: int) -> DataFrame:
    sizes = rows.groupBy("s").agg(F.count("*").alias("size"))
    bands = rows.groupBy("s", "b").agg(F.count("*").alias("band_size"))
    one = _candidates(rows, budget).join(sizes, "s").join(bands, ["s", "b"]).withColumn("one", F.lit(1))

    def draw(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_steps(t, quota, per_repo, per_dep, budget), columns=["s", "r", "d", "f", "nth", "filled"])

    return one.groupBy("one").applyInPandas(draw, _DRAWN)  # bounded by rule C


def greedy_draw(pool: DataFrame, quotas: DataFrame, stratum: str, repo: str, dep: str, per_repo: int, per_dep: int, budget: int) -> DataFrame:
    """(stratum, repo, dep) of at most `budget` pairs: strata from the smallest, in each up to its quota the pair whose
    repository, then dependency, has been drawn least, within caps; ties by name. quotas(stratum, quota) has a row a stratum."""
    rows = _pool(pool, stratum, repo, dep, F.lit(0).cast("long"), F.lit(0))
    wanted = {r[0]: int(r[1]) for r in quotas.select(stratum, "quota").collect()}  # a row a stratum
    found = _drawn(rows, lambda sizes: wanted, per_repo, per_dep, budget)
    return found.select(F.col("s").alias(stratum), F.col("r").alias(repo), F.col("d").alias(dep))


def stratified_draw(pool: DataFrame, stratum: str, repo: str, dep: str, footprint: str, n: int, per_repo: int, per_dep: int, band: Callable[[Column], Column]) -> DataFrame:
    """(stratum, repo, dep, footprint, nth, filled) of n pairs, as far as caps allow.

    Quotas follow the strata's sizes by largest remainders. In a stratum, from the smallest, each step takes the pair of the
    repository, then of the dependency, that has been drawn least, then of the footprint band that is shortest of its share,
    then by name. What caps leave open is filled from the whole pool: those pairs in order of how often repository and
    dependency had been drawn, then how far the footprint is from the pool's median, then by name, within the caps. A null
    footprint is a band of its own and farthest from the median."""
    rows = _pool(pool, stratum, repo, dep, F.col(footprint).cast("long"), F.coalesce(band(F.col(footprint)).cast("string"), F.lit("")))
    drawn = cut(_drawn(rows, lambda sizes: _quotas(sizes, n), per_repo, per_dep, n))
    taken = drawn.count()
    filled = drawn.limit(0)
    if taken < n:
        middle = rows.agg(F.median("f")).first()[0]
        times = lambda c, name: drawn.groupBy(c).agg(F.count("*").alias(name))  # noqa: E731 (n rows at most)
        rest = rows.join(F.broadcast(drawn.select("s", "r", "d")), ["s", "r", "d"], "left_anti")
        rest = rest.join(F.broadcast(times("r", "nr")), "r", "left").join(F.broadcast(times("d", "nd")), "d", "left").na.fill(0, ["nr", "nd"])
        rest = rest.withColumn("off", F.coalesce(F.abs(F.col("f") - F.lit(middle)), F.lit(float("inf"))))
        order = ["nr", "nd", "off", "r", "d", "s"]
        # of a repository's pairs at most n fail for their dependency's cap, so the ones behind come too late; and so on
        tasks = parts(rows.sparkSession, rows.count())
        rest = _first(rest.where((F.col("nr") < per_repo) & (F.col("nd") < per_dep)).repartition(tasks, "r"), ["r"], order, n + per_repo)
        rest = _first(rest.repartition(tasks, "d"), ["d"], order, n + per_dep)
        near = rest.orderBy(*order).limit(n * (2 * n + per_repo + per_dep) + n).withColumn("one", F.lit(1))

        def fill(t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values(order)
            repos, deps = dict(zip(t["r"], t["nr"], strict=True)), dict(zip(t["d"], t["nd"], strict=True))
            out = []
            for s, r, d, f in zip(t["s"], t["r"], t["d"], t["f"], strict=True):
                if taken + len(out) < n and repos[r] < per_repo and deps[d] < per_dep:
                    repos[r] += 1
                    deps[d] += 1
                    out.append((s, r, d, f, taken + len(out) + 1, True))
            return pd.DataFrame(out, columns=["s", "r", "d", "f", "nth", "filled"])

        filled = near.groupBy("one").applyInPandas(fill, _DRAWN)  # bounded by n and the caps
    return drawn.unionByName(filled).select(F.col("s").alias(stratum), F.col("r").alias(repo), F.col("d").alias(dep), F.col("f").alias(footprint), "nth", "filled")
