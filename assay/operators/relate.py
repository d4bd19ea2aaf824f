"""Joins and windows beyond the built-in forms. All are equi-joins, or windows within a key."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .graph import cut, to_all


def last_wins(tables: list[DataFrame], keys: list[str], tie: str) -> DataFrame:
    """Union in which a later table's row replaces an earlier one's; within a table the largest `tie` stays."""
    parts = [t.withColumn("__source", F.lit(i)) for i, t in enumerate(tables)]
    every = reduce(DataFrame.unionByName, parts)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__source"), F.desc(tie)))
    return every.withColumn("__nth", nth).where("__nth = 1").drop("__source", "__nth")


def universe(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys of any table, with each table's value column (its name) or null."""
    return reduce(lambda a, b: a.join(b, key, "full"), [t.select(key, name) for name, t in tables.items()])


def fallback_lookup(rows: DataFrame, table: DataFrame, keys: list[Column], table_key: str, value: str) -> DataFrame:
    """rows with the value found by the first of several keys that the table has. table_key is unique."""
    for i, k in enumerate(keys):
        rows = rows.withColumn(f"__k{i}", k)
        own = table.select(F.col(table_key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        rows = rows.join(own, f"__k{i}", "left")
    found = F.coalesce(*[F.col(f"__v{i}") for i in range(len(keys))])
    return rows.withColumn(value, found).drop(*[f"__{x}{i}" for i in range(len(keys)) for x in "kv"])


def positional_pairs(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The i-th of a key on one side with the i-th on the other; what is left over stands alone."""
    w = Window.partitionBy(key).orderBy(order)
    number = lambda t, name: t.select(key, F.row_number().over(w).alias("nth"), F.col(value).alias(name))
    return number(left, "a").join(number(right, "b"), [key, "nth"], "full")


def as_of(events: DataFrame, states: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each event with the last state at or before it: one union and one window per key, no range join."""
    marked = events.select(key, at, F.lit(1).alias("__event"), F.lit(None).cast(states.schema[value].dataType).alias(value), F.struct(*events.columns).alias("__row"))
    known = states.select(key, at, F.lit(0).alias("__event"), value, F.lit(None).cast(marked.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(key).orderBy(at, "__event").rowsBetween(Window.unboundedPreceding, 0)
    seen = marked.unionByName(known).withColumn("__last", F.last(value, ignorenulls=True).over(w))
    return seen.where("__event = 1").select("__row.*", F.col("__last").alias(value))


def interval_join(points: DataFrame, spans: DataFrame, key: str, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points in closed integer spans of the same key: spans are dealt to buckets of `width`, then an equi-join and a
    filter. A span of n units is repeated n / width times."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    dealt = spans.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    found = points.withColumn("__cell", cell(point)).join(dealt, [key, "__cell"])
    return found.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__cell")


#: Up to so many different tokens of the right side, its most frequent ones, every task gets with their numbers; and the bits of
#: a set's parity sketch, and of the table that tells which other tokens the right has.
VOCABULARY = 1_000_000
SKETCH = 16  # of 64 bits
KNOWN = 1 << 20  # of 64 bits
#: Rows of left sets' first tokens that best_match() sends to every task at a time.
STARTS = 500_000


def _token_sets(rows: DataFrame, key: str, token: str, name: str) -> DataFrame:
    """(name, n, ws, c): each key's set of token hashes in order, their number, and a hash of the set. token is a token or an
    array of them; only arrays of a key that has several rows are shuffled."""
    hashed = F.xxhash64(token)
    if isinstance(rows.schema[token].dataType, ArrayType):
        own = rows.select(F.col(key).alias(name), F.array_sort(F.array_distinct(F.transform(F.array_compact(token), lambda w: F.xxhash64(w)))).alias("ws"))
        sets = cut(own.where(F.col(name).isNotNull())).where(F.size("ws") > 0)  # a filter ahead of it would make the sets twice
        twice = to_all(sets.groupBy(name).agg(F.count("*").alias("k")).where("k > 1").select(name))
        if not twice.isEmpty():
            merged = cut(sets.join(twice, name, "left_semi").groupBy(name).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("ws")))
            sets = sets.join(twice, name, "left_anti").unionByName(merged)
    else:
        sets = cut(rows.where(F.col(key).isNotNull() & F.col(token).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.array_sort(F.collect_set(hashed)).alias("ws")))
    return sets.select(name, F.size("ws").alias("n"), "ws", F.xxhash64("ws").alias("c"))


def _once(sets: DataFrame, name: str) -> DataFrame:
    """Of equal sets the one of the smallest name; the sets themselves aren't shuffled while few stand several times."""
    twice = to_all(sets.groupBy("c", "n").agg(F.min(name).alias("least"), F.count("*").alias("k")).where("k > 1").select("c", "n", "least"))
    return sets.join(twice, ["c", "n"], "left").where(F.col("least").isNull() | (F.col("least") == F.col(name))).select(*sets.columns)


def _vocabulary(rights: DataFrame) -> Broadcast:
    """(hashes in order, how often the right has each, bits): its most frequent tokens, and a table of bits of all others,
    none if there are no others."""
    often = cut(rights.select(F.explode("ws").alias("h")).groupBy("h").agg(F.count("*").alias("often")))
    total, least, bits = often.count(), 0, None
    if total > VOCABULARY:
        held = 0
        for r in sorted(cut(often.groupBy("often").count()).collect(), reverse=True):  # as many rows as different numbers
            held, least = held + r["count"], r.often + 1 if held + r["count"] > VOCABULARY else r.often
            if held > VOCABULARY:
                break
        at = F.col("h").bitwiseAND(64 * KNOWN - 1)
        words = cut(often.select(F.shiftright(at, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit"))).toPandas()  # KNOWN rows at most
        bits = np.zeros(KNOWN, np.int64)
        bits[words["at"].to_numpy()] = words["bit"].to_numpy()
    most = often.where(F.col("often") >= least).toPandas().sort_values("h")  # VOCABULARY rows at most
    return rights.sparkSession.sparkContext.broadcast((most["h"].to_numpy(np.int64), most["often"].to_numpy(np.int64), bits))


def _starts(sets: DataFrame, side: str, vocabulary: Broadcast, least: float, words: int = SKETCH) -> DataFrame:
    """(c, n, m, at, h, s0 ...) of the tokens with which each of sets(c, n, ws) may be met, names ending in side; m of its tokens
    are known to the right, and s0 ... are so many words of their sketch. Inside the row: no set is shuffled."""

    def run(batches):
        hashes, often, bits = vocabulary.value
        for whole in batches if len(hashes) or bits is not None else ():
            for low in range(0, whole.num_rows, 1000):
                b = whole.slice(low, 1000)
                c, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
                h = b.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                met = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                known = met if bits is None else met | ((bits[(h & (64 * KNOWN - 1)) >> 6] >> (h & 63)) & 1 == 1)
                count = np.where(met, often[at], 0)[known] if len(hashes) else np.zeros(known.sum(), np.int64)
                h, row = h[known], row[known]
                m = np.bincount(row, minlength=len(n))
                parity = np.bincount(row * 64 * words + (h & (64 * words - 1)), minlength=len(n) * 64 * words) & 1 if words else np.zeros(0)
                sketch = np.packbits(parity.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<i8").reshape(len(n), words)
                order = np.lexsort((h, count, row))
                h, row = h[order], row[order]
                nth = np.arange(len(h)) - (np.cumsum(m) - m)[row]
                first = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1 - (n - m)
                some = (m >= least * n - 1e-9)[row] & (nth < first[row])
                h, row, nth = h[some], row[some], nth[some]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[row], n[row], m[row], nth + 1 + (n - m)[row], h, *sketch[row].T)], schema=schema)

    names = [*(f"{x}{side}" for x in ("c", "n", "m", "at")), "h", *(f"s{side}{i}" for i in range(words))]
    schema = pa.schema([(x, pa.int64()) for x in names])
    return sets.select("c", "n", "ws").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def best_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, token: str, least: float, least_tokens: int = 1, least_left: int = 1) -> DataFrame:
    """For each left id the right id with the largest Jaccard likeness of token sets, if at least `least` (above 0); ties go
    to the smallest id. Sets of fewer than `least_tokens` tokens don't take part, nor left ones of fewer than `least_left`. token is a token, one row each, or an array
    of tokens; exact up to 64-bit hashes of tokens and of sets.

    Equal sets are one: a left set that the right has is answered by that, and others go once, however often they stand.
    A prefix filter: with all tokens in one order, those first that the right lacks, then the rarest, two sets that are so alike
    share one of their first n - ceil(least * n) + 1 tokens, so common words bring no pairs. Where two sets meet, their lengths,
    the places of the token and the bits in which their parity sketches differ bound what they can share; this drops nearly all
    before anything of a pair is shuffled. What is left is counted exactly.

    Meetings may grow with the square of the rows, so the left sets go in passes, each to all tasks: there a right set meets
    them with all its tokens at once, and only what the bounds leave of the pairs is shuffled. A pass leaves its best matches."""
    a = _token_sets(left, left_id, token, "l").where(F.col("n") >= max(least_tokens, least_left))
    rights = _once(_token_sets(right, right_id, token, "r").where(F.col("n") >= least_tokens), "r")
    same = a.select("l", "c", "n").join(rights.select("c", "n", "r"), ["c", "n"]).select("l", "r", "n", F.lit(1.0).alias("jaccard"))
    lefts = _once(a, "l").join(to_all(rights.select("c", "n"), 4 * VOCABULARY), ["c", "n"], "left_anti")
    vocabulary = _vocabulary(rights)
    starts = lambda t, side, *words: _starts(t, side, vocabulary, least, *words)
    passes = max(1, math.ceil(starts(lefts, "a", 0).count() / STARTS))
    best = [cut(_best(lefts.where(F.pmod("c", F.lit(passes)) == i), rights, starts, least)) for i in range(passes)]
    found = a.select("l", F.col("c").alias("ca"), F.col("n").alias("na")).join(reduce(DataFrame.unionByName, best), ["ca", "na"]).select("l", "x.r", "x.shared", "x.jaccard")
    every = found.unionByName(same.select("l", "r", F.col("n").cast("long").alias("shared"), "jaccard"))
    return every.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "shared", "jaccard")


def _best(lefts: DataFrame, rights: DataFrame, starts: Callable[..., DataFrame], least: float) -> DataFrame:
    """(ca, na, x): the best of the rights for each of the lefts."""
    alike = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    need = F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - 1e-6
    placed = F.least("ata", "atb") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= need
    differ = sum(F.bit_count(F.col(f"sa{i}").bitwiseXOR(F.col(f"sb{i}"))) for i in range(SKETCH))
    close = F.col("ma") + F.col("mb") - differ >= 2 * need
    met = starts(rights, "b").join(F.broadcast(starts(lefts, "a")), "h").where(alike & placed & close)
    # the last place at which they meet leaves so many tokens on either side
    pairs = met.groupBy("ca", "na", "cb", "nb").agg(F.count("*").alias("k"), F.max("ata").alias("ata"), F.max("atb").alias("atb"))
    pairs = to_all(pairs.where(F.col("k") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= need).select("ca", "na", "cb", "nb"))
    one = lambda t, side, *more: t.select(F.col("c").alias(f"c{side}"), F.col("n").cast("long").alias(f"n{side}"), F.col("ws").alias(f"ws{side}"), *more)
    asked = one(rights, "b", "r").join(pairs.select("cb", "nb").distinct(), ["cb", "nb"], "left_semi")
    both = one(lefts, "a").join(pairs, ["ca", "na"]).join(asked, ["cb", "nb"])
    shared = both.select("ca", "na", "nb", "r", F.size(F.array_intersect("wsa", "wsb")).cast("long").alias("shared"))
    scored = shared.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("jaccard") >= least)
    return scored.groupBy("ca", "na").agg(F.min(F.struct((-F.col("jaccard")).alias("less"), "r", "shared", "jaccard")).alias("x"))


def first_per_group(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def gaps(present: DataFrame, key: str, index: str) -> DataFrame:
    """Missing runs [low, high) between a key's smallest and largest index."""
    after = F.lead(index).over(Window.partitionBy(key).orderBy(index))
    seen = present.select(key, index).distinct().withColumn("high", after)
    return seen.where(F.col("high") > F.col(index) + 1).select(key, (F.col(index) + 1).alias("low"), "high")


def carry_forward(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def drop_regions(rows: DataFrame, key: str, order: str, begins: Column, ends: Column) -> DataFrame:
    """Rows outside of begin ... end marks, without the marks."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(begins.cast("int")).over(w) - F.sum(ends.cast("int")).over(w)
    return rows.withColumn("__depth", depth).where((F.col("__depth") <= 0) & ~ends).drop("__depth")
