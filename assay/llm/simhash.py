"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Fingerprints that differ in at most d < 5 bits differ in at most d bytes, so
they share at least 8 - d of the (position, byte) tokens: the guaranteed minimum. Lists of single tokens would hold
1/256 of all fingerprints each and pairs would grow with the square of the corpus, so a posting list is keyed by three
tokens: twenty triples of positions are enough that any four positions hold one of them, so every pair that shares four
tokens meets. For each pair that meets, the shared positional bytes are tallied; pairs whose tally reaches the minimum are
verified by their Hamming distance.

Work is on distinct fingerprints; copies of a text fold into one before the index is built. A list leaves only a
spanning forest of its links, which keeps every connection and never all pairs. Lists longer than LONG are dealt out as
pairs of blocks to many tasks.

Null text is the empty text; a text without words has fingerprint zero and is linked like any other. Repeated rows and
repeated ids are kept as rows. A null id is never chosen as a component's id unless all its members' ids are null. An
empty table gives an empty result. Other columns play no part in near_duplicates() and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, text_blocks, text_or_empty

#: Distinct fingerprints of a posting list that one task compares; longer lists are split into blocks of about this size.
LONG = 2048
_BLOCK = 1 << 18
#: Edges that one task contracts at most, about.
EDGES = 500_000
#: Parts that the members of components are dealt into, so that one giant component isn't one task.
SALTS = 16
#: Turan's system: three groups of positions, the triples within one and those of two from a group and one from the next.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = tuple(t for t in combinations(range(8), 3) if any(len(set(t) & set(g)) == 3 or (len(set(t) & set(g)) == 2 and len(set(t) & set(_GROUPS[(i + 1) % 3])) == 1) for i, g in enumerate(_GROUPS)))


def simhash_texts(texts: list[bytes], k: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if it is set in over half the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in text_blocks(texts):
        offsets, hashes = Words(texts[a:b], k).row_hashes(seed)
        count = np.zeros((b - a, 64), np.int64)
        for lo in range(0, len(hashes), _BLOCK):
            hi = min(lo + _BLOCK, len(hashes))
            bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.searchsorted(offsets, lo, "right") - 1
            last = np.searchsorted(offsets, hi, "left") - 1
            rows = np.arange(first, last + 1)
            rows = rows[offsets[rows + 1] > offsets[rows]]
            count[rows] += np.add.reduceat(bits, np.maximum(offsets[rows], lo) - lo, axis=0, dtype=np.int32)
        ones = (2 * count > np.diff(offsets)[:, None]).astype(np.uint8)
        out[a:b] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = simhash_texts(batch.column(1).to_pylist(), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _near(x: np.ndarray, bits: int) -> np.ndarray:
    """Of xors of fingerprints: does the tally of equal positional bytes reach the minimum, and the distance keep the bound?"""
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1, dtype=np.int8)
    near = tally >= 8 - bits
    near[near] = np.bitwise_count(x[near]) <= bits
    return near


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (smallest of its group, member) with the connections of all pairs of fp within so many bits."""
    m = len(fp)
    root = np.arange(m)
    u = fp.view(np.uint64)
    todo = np.arange(m)
    for start in range(m):  # breadth-first from each unseen one; each is expanded once
        if root[start] != start or start not in todo:
            continue
        todo = todo[todo != start]
        front = np.array([start])
        while len(front) and len(todo):
            near = np.zeros(len(todo), bool)
            for lo in range(0, len(front), 256):
                near |= _near(u[front[lo : lo + 256], None] ^ u[None, todo], bits).any(axis=0)
            front = todo[near]
            root[front] = start
            todo = todo[~near]
        if not len(todo):
            break
    return [(int(fp[r]), int(fp[i])) for i, r in enumerate(root) if r != i]


def _between(a: np.ndarray, b: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """For each member of a that has links into b: one link; and for each of b one into a. With the forests inside a and
    inside b that isn't enough, so all links are reduced to a forest over both blocks."""
    out, both = [], np.r_[a, b]
    root = list(range(len(both)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ua, ub = a.view(np.uint64), b.view(np.uint64)
    for lo in range(0, len(a), 256):
        for i, j in np.argwhere(_near(ua[lo : lo + 256, None] ^ ub[None, :], bits)).tolist():
            x, y = find(lo + i), find(len(a) + j)
            if x != y:
                root[y] = x
                out.append((int(a[lo + i]), int(b[j])))
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(sorted(set(pairs)), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.zeros(len(x), bool))], names=["a", "b", "long"])


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints fps(fp) that connect just what lies within so many bits."""
    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4: pairs that share fewer than four bytes don't all meet in the index")
    keys = []
    for at in TRIPLES:
        mask = sum(0xFF << (8 * i) for i in at)
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), F.lit(sum(1 << i for i in at))))
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp, too_long = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def passed(key: int, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), key)), pa.array(fp), pa.array(np.ones(len(fp), bool))], names=["a", "b", "long"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if too_long is not None:  # the rest of a list that is being dealt out
                n = int(np.searchsorted(key != too_long, True))
                if n:
                    yield passed(too_long, fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                too_long = None
            key, fp = np.r_[kept_key, key], np.r_[kept_fp, fp]
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts = np.r_[0, cuts]
            ends = np.r_[cuts, len(key)]
            last = starts[-1]
            pairs: list[tuple[int, int]] = []
            # lists of two, the most by far, all at once
            two = starts[:-1][(ends - starts)[:-1] == 2]
            near = two[_near((fp[two] ^ fp[two + 1]).view(np.uint64), bits)]
            pairs += zip(np.minimum(fp[near], fp[near + 1]).tolist(), np.maximum(fp[near], fp[near + 1]).tolist(), strict=True)
            for i in np.flatnonzero((ends - starts)[:-1] > 2):
                s, e = starts[i], ends[i]
                if e - s > LONG:
                    yield passed(int(key[s]), fp[s:e])
                else:
                    pairs += _forest(np.sort(fp[s:e]), bits)
            if pairs:
                yield _edges(pairs)
            kept_key, kept_fp = key[last:], fp[last:]
            if len(kept_key) > LONG:
                yield passed(int(kept_key[0]), kept_fp)
                too_long, kept_key, kept_fp = int(kept_key[0]), kept_key[:0], kept_fp[:0]
        if len(kept_fp) > 1 and (pairs := _forest(np.sort(kept_fp), bits)):
            yield _edges(pairs)

    grouped = postings.select("key", "fp").repartition("key").sortWithinPartitions("key")
    first = cut(grouped.mapInArrow(run, "a long, b long, long boolean"))
    short = first.where(~F.col("long")).select("a", "b")
    hot = first.where("long").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / LONG).cast("int").alias("n"))
    blocks = hot.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    dealt = blocks.select("key", "fp", "mine", F.explode(others).alias("ij")).select("key", "fp", "mine", "ij.i", "ij.j")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        fp, mine = t.column("fp").to_numpy(), t.column("mine").to_numpy()
        pairs = _forest(np.sort(fp), bits) if i == j else _between(fp[mine == i], fp[mine == j], bits)
        return pa.Table.from_batches([_edges(pairs)]).select(["a", "b"])

    long = dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
    return short.unionByName(long).distinct()


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges u-v, without those smallest nodes."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)  # sorted, so the smaller place is the smaller node
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]
        if (low == before).all():
            break
    far = low != np.arange(len(nodes))
    return nodes[far], nodes[low[far]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """edges(u, v) with the same components, in `parts` tasks: each gives the stars of the edges it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
        if held:
            u, v = _stars(*np.concatenate(held, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.coalesce(parts).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of edges(a, b): root is the smallest node reachable.

    Edges are first contracted in blocks of about EDGES, each in one task; a single block is done then. Several blocks go
    on by alternating large-star and small-star rounds; each is joins and minima only, and lineage is cut every round."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    parts = max(1, -(-now.count() // EDGES))
    now, mark = cut(_contracted(now, parts)), None
    for _ in range(max_rounds if parts > 1 else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, bits: int = 4) -> DataFrame:
    """Every row of docs as (id_col, fp, component_id); component_id is the smallest id reachable over links."""
    rows = cut(fingerprints(docs, id_col, text_col, k))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    members = joined_components(nodes, bits)
    alone = nodes.join(members.select("fp"), "fp", "left_anti")
    ids = members.select("fp", F.col("least").alias("component_id")).unionByName(alone.select("fp", F.col("first").alias("component_id")))
    return rows.join(ids, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def joined_components(nodes: DataFrame, bits: int) -> DataFrame:
    """(fp, first, least) for the fingerprints of nodes(fp, first) that have links: least is the smallest first of their
    component. `least` of a component is repeated SALTS times and dealt out by root and salt, so that its members meet it
    in many partitions; dealt by root alone, as the aggregate leaves it, the join would put them all into one."""
    roots = cut(connected_components(links(nodes.select("fp"), bits)))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    least = placed.groupBy("root").agg(F.min("first").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).repartition("root", "salt")
    return placed.join(least, ["root", "salt"]).select("fp", "first", "least")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, bits: int = 4) -> DataFrame:
    """docs with one row of each component; all columns as they were, whatever their names.

    The row of the smallest id stays, null ids after all others; of repeated ids the one with the smallest text hash, and of
    rows that agree in both any one. Rows are folded by fingerprint, in one shuffle of texts whose map side already drops
    copies; a component then keeps the fingerprint that holds its smallest row."""
    id_, text = F.col(f"`{id_col}`").cast("long"), text_or_empty(text_col).cast("binary")

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(simhash_texts(texts.tolist(), k).view(np.int64))

    order = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("h"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(docs.columns)]).alias("row"), order.alias("at"), fingerprint(text).alias("fp"))
    nodes = cut(rows.groupBy("fp").agg(F.min("at").alias("at")).select("fp", F.struct("at", "fp").alias("first")))
    later = joined_components(nodes, bits).where("first <> least").select("fp")
    folded = rows.groupBy("fp").agg(F.min_by("row", "at").alias("row"))
    kept = folded.join(later, "fp", "left_anti")
    return kept.select(*[F.col("row").getField(str(i)).alias(c) for i, c in enumerate(docs.columns)])
