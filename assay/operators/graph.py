"""Reachability over edge tables: breadth-first rounds of joins, with lineage cut by checkpoints."""

from __future__ import annotations

import contextlib
import functools
import math
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_TASK = 500_000  # rows
FEW = 1_000_000  # rows that go to every task
PAIRS = 50_000_000  # of users and last steps that through_others() moves at a time, or twice its edges if these are more


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of spark.sql that hold for a while."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """df, written once and without what it was made from; the shuffle files that led to it are deleted."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="assay-"))
    with settings(df.sparkSession, classic__shuffleDependency__fileCleanup__enabled="true"):
        return df.select("*").checkpoint(eager=True)  # a query made now, for one made before keeps its files


def to_all(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, kept; with at most `most` rows a join sends it to every task and leaves the other side where it is."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def parts(spark: SparkSession, rows: float) -> int:
    """As many tasks as `rows` ask for: what one of them sorts or hashes doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / PER_TASK))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of what edges(src, dst) lead to from seeds(node); depth is the fewest steps. Cycles end by
    themselves; max_depth bounds the closure."""
    links = cut(edges.select("src", "dst").distinct())
    seen = front = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    step = 0
    while max_depth is None or step < max_depth:
        step += 1
        ahead = front.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # of checkpoints, so the plan grows but nothing is computed again
        if step % 8 == 0:
            seen = cut(seen)
    return seen


def bounded_closure(edges: DataFrame, depth: int) -> DataFrame:
    """(root, node) pairs within `depth` steps of every source. The result itself may be as large as the square of the
    nodes, so it is meant for sparse graphs or few sources; only new pairs go on a step."""
    links = cut(edges.select("src", "dst").distinct())
    pairs = front = links.select(F.col("src").alias("root"), F.col("dst").alias("node"))
    for _ in range(depth - 1):
        ahead = front.join(links, front["node"] == links["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(pairs, ["root", "node"], "left_anti"))
        pairs = pairs.unionByName(front)
    return pairs


def through_others(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) whose dst is also one or two steps from another dst of the same src.

    Of the ways from src to a node only the least and the greatest first step are kept: if dst is reached by any way whose
    first step isn't dst, it is by one of them. phantoms() goes any number of steps; this plan for two meets the users of
    each dst with those that lead to it, which is the smaller side where few nodes lead on and each to many. What meets
    may be many times the edges, so the sources go in as many passes as keep it in proportion to them; a pass leaves only what it found."""
    spark = edges.sparkSession
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    inner = cut(links.join(to_all(links.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst").distinct())
    # only who has a way and who can be its last step take part, so few pairs are met where few nodes lead on; the one narrows
    # the other, for as long as what the users use is few enough to go to every task
    firsts, lasts = to_all(inner.select("src").distinct()), to_all(inner.select(F.col("dst").alias("mid")).distinct())
    for _ in range(4):
        goals = cut(links.join(firsts, "src", "left_semi").select("dst").distinct())
        if goals.count() > FEW:
            break
        before, lasts = lasts.count(), to_all(links.join(F.broadcast(goals), "dst", "left_semi").select(F.col("src").alias("mid")).distinct().join(lasts, "mid", "left_semi"))
        if lasts.count() == before:
            break
        there = inner.join(lasts.withColumnRenamed("mid", "dst"), "dst", "left_semi").select("src").distinct()
        firsts = to_all(there.unionByName(inner.join(there.select(F.col("src").alias("dst")), "dst", "left_semi").select("src")).distinct())
    users = links.join(firsts, "src", "left_semi")
    steps = links.select(F.col("src").alias("mid"), "dst").join(lasts, "mid", "left_semi")
    sides = users.select("dst", F.lit(1).alias("u"), F.lit(0).alias("s")).unionByName(steps.select("dst", F.lit(0).alias("u"), F.lit(1).alias("s")))
    met = sides.groupBy("dst").agg(F.sum("u").alias("u"), F.sum("s").alias("s")).agg(F.sum(F.col("u") * F.col("s")).alias("pairs"), (F.sum("u") + F.sum("s")).alias("rows"))
    size = cut(met).first()  # one row
    n, passes = parts(spark, size.rows or 0), max(1, math.ceil((size.pairs or 0) / max(PAIRS, 2 * (size.rows or 0))))
    leads = steps.repartition(n, "dst").groupBy("dst").agg(F.collect_set("mid").alias("mids"))
    leads = leads if passes == 1 else cut(leads)
    found = [_through_others(users, leads, inner, lasts, n, passes, i) for i in range(passes)]
    if passes == 1:
        return found[0]
    with settings(spark, requireAllClusterKeysForCoPartition="false"):
        kept = [cut(f.groupBy("src").agg(F.collect_list("dst").alias("dst"))) for f in found]
    return functools.reduce(DataFrame.unionByName, kept).select("src", F.explode("dst").alias("dst"))


def _through_others(users: DataFrame, leads: DataFrame, inner: DataFrame, lasts: DataFrame, n: int, passes: int, at: int) -> DataFrame:
    """What through_others() finds for one of `passes` parts of the sources. Who leads to a dst goes to its users as one array,
    and all that a source needs is dealt to one of n tasks."""
    ours = lambda t: t.where(F.pmod(F.xxhash64("src"), F.lit(passes)) == at)
    deal = lambda t: t if passes == 1 else t.repartition(n, "src")
    ends = inner.join(lasts.withColumnRenamed("mid", "dst"), "dst", "left_semi").select("src", "dst")
    one = ours(ends).select("src", F.col("dst").alias("mid"), F.col("dst").alias("via"))
    two = ours(inner).withColumnRenamed("dst", "via").join(ends.select(F.col("src").alias("via"), F.col("dst").alias("mid")), "via").select("src", "mid", "via")
    ways = deal(one.unionByName(two)).groupBy("src", "mid").agg(F.min("via").alias("low"), F.max("via").alias("high"))
    last = deal(ours(users).repartition(n, "dst").join(leads.repartition(n, "dst"), "dst").select("src", "dst", "mids"))
    pairs = last.select("src", "dst", F.explode("mids").alias("mid"))
    way = ways.select(F.col("src").alias("s"), F.col("mid").alias("m"), "low", "high").hint("shuffle_hash")
    first = (F.col("src") == F.col("s")) & (F.col("mid") == F.col("m")) & ((F.col("low") != F.col("dst")) | (F.col("high") != F.col("dst")))
    return pairs.join(way, first, "left_semi").select("src", "dst").distinct()


def closures(requires: DataFrame, seeds: DataFrame, key: list[str], depth: int) -> DataFrame:
    """(key, node, hops): what each key's seeds(key, node) lead to over requires(src, dst) in at most `depth` hops, the seeds
    themselves with 0. All keys go at once: a frontier of (key, node) rows is joined with the edges, and only new rows go on.
    Rows with a null node, and edges with a null end, are left out."""
    spark, whole = requires.sparkSession, [*key, "node"]
    links = requires.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    links = cut(links.repartition(parts(spark, links.count()), "src").distinct())
    n_links = links.count()
    fan = n_links / max(1, links.select("src").distinct().count())
    rows = seeds.select(*whole).where("node IS NOT NULL")
    seen = front = cut(rows.repartition(parts(spark, rows.count()), *whole).distinct().withColumn("hops", F.lit(0)))
    n = n_seen = front.count()
    for hop in range(1, depth + 1):
        met, told = parts(spark, max(n, n_links)), parts(spark, max(n * fan, n_seen))
        ahead = front.select(*key, F.col("node").alias("src")).repartition(met, "src").join(links.repartition(met, "src"), "src")
        ahead = ahead.select(*key, F.col("dst").alias("node")).repartition(told, *whole).distinct()
        front = cut(ahead.join(seen.select(*whole).repartition(told, *whole), whole, "left_anti").withColumn("hops", F.lit(hop)))
        n = front.count()
        if not n:
            break
        n_seen += n
        seen = seen.unionByName(front)
    return seen


def phantoms(declared: DataFrame, requires: DataFrame, depth: int = 6) -> DataFrame:
    """(src, dst, via, hops): the declared(src, dst) that would still be installed if src dropped them, because another of its
    dependencies leads there over requires(src, dst) in at most `depth` hops; via is the smallest such dependency and hops
    the fewest hops in which any of them does.

    What a dependency leads to is followed once, whoever declares it, and only to nodes that anyone declares does it come
    back to those that declare it: each such (src, via, node) is shuffled once, to meet src's declaration of node."""
    wants = cut(declared.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    nodes = wants.select("dst").distinct()
    ahead = closures(requires, nodes.select(F.col("dst").alias("via"), F.col("dst").alias("node")), ["via"], depth)
    leads = ahead.where("hops > 0 AND via <> node").join(nodes.withColumnRenamed("dst", "node"), "node", "left_semi")
    reached = wants.withColumnRenamed("dst", "via").join(leads, "via").select("src", F.col("node").alias("dst"), "via", "hops")
    return reached.join(wants, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("via").alias("via"), F.min("hops").alias("hops"))
