"""Exact Jaccard join of documents by their distinct word shingles: a blocked sparse matrix product with size bounds.

Rows of the incidence matrix are documents (equal sets are one row), columns are shingles, as 64-bit hashes. The product of
the matrix with its transpose holds every overlap, and a pair links if its overlap reaches the size-derived bound
ceil(t / (1 + t) * (|A| + |B|)). Three bounds keep the product small, and none loses a pair:

* Columns are put into one order for all rows, frequent ones last. A row that links has the least overlap ceil(t * |A|), so
  only its first |A| - ceil(t * |A|) + 1 columns take part: two rows that share none of these can't reach the bound.
* Blocks of columns add up the overlaps of pairs of like sizes; a pair is discarded when the sum so far, and all that may
  follow its last shared column, stay below the bound.
* Each row has a sketch, the parity of its hashes in some cells. Two sketches differ in no more cells than the sets in
  elements, so a pair that differs in more cells than the bound allows is discarded. Of two sketches the longer one is
  folded to the other's length.

What is left is settled by the whole sets, which are built again from the texts for these rows alone, group by group of
rows that pairs connect; a pair whose rows are connected already needs no look. Columns of more than
SMALL rows first give only neighbouring pairs; after these are settled, only pairs of rows that aren't connected yet are
compared, in blocks of LONG rows. So copies that are all like each other never give all their pairs.

Which columns count as frequent changes the cost only: tasks count shingles that occur LEAST times in one of their windows,
and those with the largest sums, at most MOST of them, are sent to all tasks.

Null texts are empty. A text without words links with nothing. With fewer words than k the whole sequence is the one
shingle. Repeated rows and ids are kept as rows. A null id is no component's id unless all ids of the component are null.
Empty tables give empty results. Other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, text_blocks, text_or_empty
from .simhash import SALTS, connected_components

#: Rows of a column that are paired at once.
SMALL = 16
#: Rows of a block of a longer column.
LONG = 2048
#: Shingles of a window, and how often one must occur in it to be counted for the order of the columns.
WINDOW, LEAST = 2_000_000, 3
#: Sum from which a column is frequent, and how many there are at most (8 bytes each in every task).
OFTEN, MOST = 64, 1_000_000
#: Cells of a sketch, at least; a power of two.
CELLS = 1024
#: Shingles, and sets, of a block that one task holds two of.
GRAMS, MEMBERS = 3_000_000, 512
#: Bits of the filter that keeps rows without candidates from being built again.
FILTER_BITS = 1 << 26


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in text_blocks(texts):
        offsets, hashes = Words(texts[a:b], k).row_hashes()
        for i in range(b - a):
            s = np.sort(hashes[offsets[i] : offsets[i + 1]])
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(s: np.ndarray) -> bytes:
    """The parity of the hashes in each cell; as many cells as hashes, in powers of two, so that long sets are told apart too."""
    cells = max(CELLS, 1 << (len(s) - 1).bit_length()) if len(s) else CELLS
    return np.packbits(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1).tobytes()


def _prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The columns of a row that take part, in the common order: by hash, frequent ones last."""
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        s = np.r_[s[~late], s[late]]
    return s[: len(s) - -(-percent * len(s) // 100) + 1]


def frequent_columns(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """The sorted hashes of the shingles that stand last in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def passed() -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= LEAST
            return pa.RecordBatch.from_arrays([pa.array(gram[many].view(np.int64)), pa.array(n[many])], names=["gram", "n"])

        for batch in batches:
            for s in _sets(batch.column(0).to_pylist(), k):
                held.append(s)
                size += len(s)
                if size >= WINDOW:
                    yield passed()
                    held, size = [], 0
        if held:
            yield passed()

    counts = cut(docs.select(text_or_empty(text_col).cast("binary")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") >= max(OFTEN, -(-total // MOST))).select("gram")  # so at most MOST
    return np.sort(np.array([r.gram for r in often.toLocalIterator()], np.int64).view(np.uint64))


def _need(na, nb, percent: int):
    """The size-derived bound of the overlap; of numbers, arrays or columns."""
    return -((-percent * (na + nb)) // (100 + percent))


def _like(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _matrix(nodes: DataFrame) -> DataFrame:
    """(gram, node, n, at): the entries of the columns that take part; at is the place in the row's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            size = np.array([len(x) for x in rows], np.int64)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(rows), np.repeat(batch.column(0).to_numpy(), size), np.repeat(batch.column(1).to_numpy(), size), at)], names=["gram", "node", "n", "at"])

    return nodes.select("node", "n", "prefix").mapInArrow(run, "gram long, node long, n long, at long")


def _product(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, rest, gram): of columns with up to SMALL rows, their pairs of like sizes, with what may follow in both
    rows; of longer ones the rows themselves as (a = node, na = n, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, passing = np.zeros((4, 0), np.int64), None

        def out(a, b, na, nb, rest, gram) -> pa.RecordBatch:
            blank = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([blank if x is None else pa.array(x) for x in (a, b, na, nb, rest, gram)], names=["a", "b", "na", "nb", "rest", "gram"])

        def long(x: np.ndarray) -> pa.RecordBatch:
            return out(x[1], None, x[2], None, None, x[0])

        def pairs(x: np.ndarray, starts: np.ndarray, m: int) -> Iterator[pa.RecordBatch]:
            for i in range(m):
                for j in range(i + 1, m):
                    p, q = x[:, starts + i], x[:, starts + j]
                    p, q = np.where(p[1] < q[1], p, q), np.where(p[1] < q[1], q, p)
                    rest = np.minimum(p[2] - p[3], q[2] - q[3]) - 1
                    good = _like(p[2], q[2], percent) & (np.minimum(p[3], q[3]) + 1 + rest >= _need(p[2], q[2], percent))
                    if good.any():
                        yield out(p[1][good], q[1][good], p[2][good], q[2][good], rest[good], None)

        def lists(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.r_[0, np.flatnonzero(np.diff(x[0])) + 1, x.shape[1]]
            size = np.diff(edges)
            for m in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
                yield from pairs(x, edges[:-1][size == m], m)
            many = np.repeat(size > SMALL, size)
            if many.any():
                yield long(x[:, many])

        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns])
            if passing is not None:  # the rest of a column that is passed on
                n = int(np.searchsorted(x[0] != passing, True))
                if n:
                    yield long(x[:, :n])
                x = x[:, n:]
                if not x.shape[1]:
                    continue
                passing = None
            x = np.concatenate([kept, x], axis=1)
            last = int(np.searchsorted(x[0], x[0, -1]))
            if last:
                yield from lists(x[:, :last])
            kept = x[:, last:]
            if kept.shape[1] > SMALL:
                yield long(kept)
                passing, kept = int(kept[0, 0]), kept[:, :0]
        if kept.shape[1]:
            yield from lists(kept)

    return entries.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "a long, b long, na long, nb long, rest long, gram long")


def _differ(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many cells each pair of sketches differs."""
    out = np.zeros(len(a), np.int64)
    size = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(size, axis=0).tolist():
        at = np.flatnonzero((size[:, 0] == la) & (size[:, 1] == lb))
        whole = max(1, 4_000_000 // (la + lb))
        for lo in range(0, len(at), whole):
            some = at[lo : lo + whole]
            x, y = (np.frombuffer(b"".join([side[i] for i in some]), np.uint64).reshape(len(some), -1) for side in (a, b))
            while x.shape[1] != y.shape[1]:
                fold = lambda z, n: np.bitwise_xor(z[:, : n // 2], z[:, n // 2 :]) if z.shape[1] == n else z
                n = max(x.shape[1], y.shape[1])
                x, y = fold(x, n), fold(y, n)
            out[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _within(x: Column, y: Column, na: Column, nb: Column, percent: int) -> Column:
    """May sets with these sketches and sizes link? |A xor B| = |A| + |B| - 2 * overlap."""

    @F.pandas_udf("int")
    def cells(a, b):
        import pandas as pd

        return pd.Series(_differ(a.tolist(), b.tolist()).astype(np.int32))

    return cells(x, y) <= na + nb - 2 * F.ceil(percent * (na + nb) / (100 + percent))


def _neighbours(long: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of like sizes that stand side by side in their block of a column, by size and by hash."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, n = t.column("a").to_numpy(), t.column("na").to_numpy()
        with np.errstate(over="ignore"):
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(key[0].as_py() & (2**64 - 1))
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        found = []
        for order in (np.lexsort((mixed, n)), np.argsort(mixed)):
            p, q = order[:-1], order[1:]
            good = _like(n[p], n[q], percent)
            found.append(np.stack([np.minimum(node[p], node[q])[good], np.maximum(node[p], node[q])[good]]))
        x = np.concatenate(found, axis=1)
        return pa.table({"a": x[0], "b": x[1]})

    return _dealt(long).groupBy("gram", "mine").applyInArrow(run, "a long, b long").distinct()


def _dealt(long: DataFrame) -> DataFrame:
    """long with its block: longer columns are dealt into ceil(size / LONG), each row by its hash with the column."""
    size = long.groupBy("gram").agg(F.ceil(F.count("*") / LONG).cast("int").alias("parts"))
    return long.join(size, "gram").withColumn("mine", F.pmod(F.xxhash64("a", "gram"), F.col("parts")).cast("int"))


def _apart(long: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of like sizes and sketches, of rows of long(gram, a, na, sketch, root) with different roots."""
    mixed = long.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    dealt = _dealt(long.join(mixed, "gram", "left_semi")).withColumn("ij", F.explode(others))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        node, n, root, mine = (t.column(c).to_numpy() for c in ("a", "na", "root", "mine"))
        sketch = t.column("sketch").to_pylist()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        found = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(left), 64):
            p = left[lo : lo + 64]
            good = (root[p][:, None] != root[right][None, :]) & _like(n[p][:, None], n[right][None, :], percent)
            if i == j:
                good &= node[p][:, None] < node[right][None, :]
            x, y = np.nonzero(good)
            x, y = p[x], right[y]
            near = _differ([sketch[v] for v in x], [sketch[v] for v in y]) <= n[x] + n[y] - 2 * _need(n[x], n[y], percent)
            x, y = node[x[near]], node[y[near]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        x = np.concatenate(found, axis=1)
        return pa.table({"a": x[0], "b": x[1]})

    return dealt.select("gram", "a", "na", "root", "sketch", "mine", "ij.i", "ij.j").groupBy("gram", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _bit(sig: bytes, least: int | None) -> int:
    return (int.from_bytes(sig[:8], "little") ^ ((least or 0) * 0x9E3779B97F4A7C15)) % FILTER_BITS


def _filter(wanted: DataFrame) -> Broadcast:
    """Bits set for the rows that stand for wanted(sig, least); of fixed size, and what it lets through wrongly the join drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([_bit(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63))], names=["w", "v"])

    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in wanted.select("sig", "least").mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():
        bits[r.w] = r.v
    return wanted.sparkSession.sparkContext.broadcast(bits)


def _whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(sig, grams): the sets of wanted(sig, least), built again from the texts; a repeated row gives its set again."""
    asked = _filter(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_blocks(texts):
                kept = []
                for i, s in zip(ids[a:b], _sets(texts[a:b], k), strict=True):
                    sig = _signature(s)
                    at = _bit(sig, i)
                    if asked.value[at >> 6] >> (at & 63) & 1:
                        kept.append((sig, s.tobytes()))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*kept, strict=True)], names=["sig", "grams"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), text_or_empty(text_col).cast("binary")).mapInArrow(run, "sig binary, grams binary")


def _linked(pairs: list[tuple[int, int]], sets: dict[int, np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A forest with the connections of those pairs that link; pairs that are connected already aren't looked at."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            both = np.sort(np.r_[sets[a], sets[b]])
            if int((both[1:] == both[:-1]).sum()) >= _need(len(sets[a]), len(sets[b]), percent):
                root[y] = x
                yield a, b


def _settled(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """(a, b): links with the connections of those of pairs(a, b) that link, by the whole sets.

    Rows that pairs connect are brought together, so that each set moves once; larger groups are dealt into blocks of
    about GRAMS shingles or MEMBERS sets, and their pairs into pairs of blocks; a set goes where its pairs are."""
    group = connected_components(pairs)
    placed = cut(nodes.select("node", "sig", "least", "n").join(group, "node"))
    parts = cut(placed.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / GRAMS), F.ceil(F.count("*") / MEMBERS)).cast("int").alias("parts")))
    dealt = placed.join(parts, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    side = lambda c: dealt.select(F.col("node").alias(c), F.col("mine").alias(f"m{c}"), "root")
    met = pairs.join(side("a"), "a").join(side("b").drop("root"), "b")
    met = cut(met.select("root", F.least("ma", "mb").alias("i"), F.greatest("ma", "mb").alias("j"), "a", "b"))
    # a set goes only where one of its pairs is
    asked = met.select(F.col("root").alias("g"), "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = asked.join(placed.select("node", "sig"), "node")
    sets = _whole_sets(docs, placed, id_col, text_col, k).join(asked, "sig").select("g", F.col("i").alias("x"), F.col("j").alias("y"), "node", "grams")

    def run(key: tuple, sets: pa.Table, pairs: pa.Table) -> pa.Table:
        grams = dict(zip(sets.column("node").to_pylist(), (np.frombuffer(x.as_buffer(), np.uint64) for x in sets.column("grams")), strict=True))
        asked = zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)
        found = np.array(list(_linked(list(asked), grams, percent)), np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return cut(sets.groupBy("g", "x", "y").cogroup(met.groupBy("root", "i", "j")).applyInArrow(run, "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: the size of its set, and the smallest id reachable over links."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be 1 to 100")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_columns(docs, text_col, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(s), _signature(s), _sketch(s), _prefix(s, frequent.value, percent).tobytes() if len(s) else b"") for s in _sets(batch.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in zip(*out, strict=True)]], names=["id", "n", "sig", "sketch", "prefix"]) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())], names=["id", "n", "sig", "sketch", "prefix"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    rows = cut(texts.mapInArrow(run, "id long, n long, sig binary, sketch binary, prefix binary"))
    classes = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("n", "sketch", "prefix")])
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    product = cut(_product(_matrix(nodes), percent))
    long = product.where("gram IS NOT NULL").select("gram", "a", "na")
    longs = long.groupBy("a").agg(F.count("*").alias("longs")).withColumnRenamed("a", "node")
    info = nodes.select("node", "sketch", F.col("n").alias("m")).join(longs, "node", "left").na.fill(0, ["longs"])
    side = lambda c: info.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("m").alias(f"n{c}"), F.col("longs").alias(f"longs_{c}"))

    def like(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(_within(F.col("sketch_a"), F.col("sketch_b"), F.col("na"), F.col("nb"), percent))

    added = product.where("gram IS NULL").groupBy("a", "b").agg(F.count("*").alias("overlap"), F.min("rest").alias("rest"), F.first("na").alias("x"), F.first("nb").alias("y"))
    bound = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    first = like(added.select("a", "b", "overlap", "rest")).where(F.col("overlap") + F.col("rest") + F.least("longs_a", "longs_b") >= bound).select("a", "b")
    pairs = cut(first.unionByName(like(_neighbours(long, percent)).select("a", "b")).distinct())
    settled = lambda p: _settled(docs, nodes, p, percent, id_col, text_col, k)
    links = settled(pairs)

    roots = cut(connected_components(links))
    placed = long.join(nodes.select(F.col("node").alias("a"), "sketch"), "a").join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    more = cut(_apart(cut(placed), percent).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        roots = cut(connected_components(links.unionByName(settled(more))))

    member = nodes.select("node", "sig", "least").join(roots, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    least = member.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).repartition("root", "salt")
    linked = member.join(least, ["root", "salt"]).select("sig", "component_id")
    alone = nodes.select("node", "sig", F.col("least").alias("component_id")).join(roots, "node", "left_anti").select("sig", "component_id")
    of_set = rows.where("n > 0").select("id", "n", "sig").join(linked.unionByName(alone), "sig").select("id", "n", "component_id")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return of_set.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
