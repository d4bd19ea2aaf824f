"""Exact repeated-substring removal with a column-wise construction of suffix order and common prefixes.

Every byte that a `length`-byte string covers which also starts anywhere else is removed; matches never cross documents.

The construction inserts one symbol of every string a round, keeps the strings in the order of what has been inserted (the
symbols to come, in that order, are the collection's Burrows-Wheeler transform) and updates the common prefixes of
neighbours. Over whole documents it would take as many rounds as the longest document has bytes, each a pass over the
collection. So the documents are first aligned: of the ANCHOR-byte strings in each `length`-byte window the one with the
smallest hash is an anchor, wherever the window stands. Equal windows hold equal anchors at the same place, so only
occurrences of one anchor need comparing, and only within `length` bytes around it:

1. Anchors whose whole surroundings recur are settled by a 64-bit hash of the surroundings, counted by Spark.
2. Different surroundings of one anchor are sorted by the column-wise construction, sequentially batch by batch from
   Spark's external sort by anchor; windows that share `length` symbols with a neighbour recur.
3. Anchors with more than LONG different surroundings are not brought together: their windows are counted by a 128-bit
   hash each, with partial sums.

Texts are treated as UTF-8 bytes; null text is the empty text. Copies of a row are other places, so texts of at least
`length` bytes that occur twice are removed whole. Repeated ids are kept as rows. An empty table gives an empty result.
Other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_blocks, text_or_empty, xxh64_spans

LENGTH = 200
ANCHOR = 64
#: Different surroundings of an anchor that one task compares.
LONG = 20_000
#: One text in so many tells which anchors are crowded, and the share of its anchors that makes one so. Both decide only
#: by which plan an anchor is counted, not the result.
SAMPLE_OF = 64
CROWDED = 0.001
#: Surroundings that are sorted at once; some 8 MB of symbols.
BATCH = 20_000
#: Bytes of a text that are hashed at once; longer texts are read in overlapping parts.
PART = 1 << 20

_symbol = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_B = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size-byte string of raw, from hashes of half the size."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, h, at, out = _B, _symbol[raw], 1, None
        have = 0
        while at <= size:
            if size & at:
                if out is None:
                    out, have = h, at
                else:
                    n = min(len(out), len(h) - have)
                    out = out[:n] * power + h[have : have + n]
                    have += at
            if 2 * at <= size:
                n = max(len(h) - at, 0)
                h = h[:n] * power + h[at : at + n]
                power = power * power
            at *= 2
        out = out[: max(len(raw) - size + 1, 0)]
        out = (out ^ (out >> np.uint64(31))) * _B
        return out ^ (out >> np.uint64(29))


def slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """np.minimum or np.maximum over each run of width values."""
    size = 1
    while size < width:
        shift = min(size, width - size)
        x = pick(x[: len(x) - shift], x[shift:])
        size += shift
    return x


def anchors(texts: list[bytes], length: int, size: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts as (bytes of all of them, where each begins and the last ends, text, place in the block, hash).

    An anchor has the smallest hash in some window of its text; ties all are anchors."""
    width = length - size + 1
    for a, b in text_blocks(texts, PART):
        data = b"".join(texts[a:b])
        start = np.r_[0, np.cumsum([len(t) for t in texts[a:b]])].astype(np.int64)
        raw, places, hashes = np.frombuffer(data, np.uint8), [], []
        for lo in range(0, max(len(raw) - length + 1, 0), PART):
            h = gram_hashes(raw[lo : lo + PART + length - 1], size)
            short = (h >> np.uint64(32)).astype(np.uint32)
            low = slide(short, width, np.minimum)
            for e in start[np.searchsorted(start, lo + 1) : np.searchsorted(start, lo + len(low) + length)].tolist():
                low[max(e - length + 1 - lo, 0) : max(e - lo, 0)] = 0  # windows over the end of a text
            edge = np.zeros(width - 1, np.uint32)
            at = np.flatnonzero(slide(np.concatenate([edge, low, edge]), width, np.maximum) == short)
            places.append(at + lo)
            hashes.append(h[at])
        if places:
            at, first = np.unique(np.concatenate(places), return_index=True)
            if len(at):
                yield data, start, a + np.searchsorted(start, at, "right") - 1, at, np.concatenate(hashes)[first]


def surroundings(data: bytes, begin: np.ndarray, end: np.ndarray, places: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, hash) of what windows over each anchor reach in its text; the hash tells where the text's ends cut it."""
    low, high = np.maximum(places - (length - size), begin), np.minimum(places + length, end)
    with np.errstate(over="ignore"):
        h = xxh64_spans(data, low, high - low, 11) ^ ((places - low).astype(np.uint64) * _B)
    return low, high, h


def column_order(strings: list[bytes], before: np.ndarray, group: np.ndarray, length: int, size: int) -> np.ndarray:
    """flags[i, c]: does the window of string i that begins c bytes into its frame recur in another string of its group?

    Strings are aligned: before[i] bytes of string i stand before its anchor. group ascends. From the last column to the
    first, every string gets one symbol a round."""
    n, lead = len(strings), length - size
    frame = np.full((n, lead + length), 256, np.int16)  # 256: beyond the string
    for i, s in enumerate(strings):
        at = lead - int(before[i])
        frame[i, at : at + len(s)] = np.frombuffer(s, np.uint8)
    order = np.arange(n)
    common = np.zeros(n, np.int32)  # with the string before in order
    new_group = np.r_[True, group[1:] != group[:-1]]
    flags = np.zeros((n, lead + 1), bool)
    block = np.cumsum(new_group) - 1
    for c in range(lead + length - 1, -1, -1):
        symbols = frame[order, c]  # the Burrows-Wheeler transform of the columns so far
        by = np.argsort(block * 257 + symbols, kind="stable")  # groups stay in place, so block is that of any order
        a, b = by[:-1], by[1:]
        same = (block[a] == block[b]) & (symbols[a] == symbols[b]) & (symbols[a] < 256)
        updated = np.zeros(n, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            bounds = np.empty(2 * len(at), np.int64)
            bounds[::2], bounds[1::2] = a[at] + 1, b[at] + 1
            low = np.minimum.reduceat(np.r_[common, np.int32(0)], bounds)[::2]
            updated[at + 1] = low + 1
        order, common = order[by], updated
        if c <= lead:
            hit = common >= length
            hit[:-1] |= hit[1:]
            flags[order[hit], c] = True
    return flags


def _spans(flags: np.ndarray, low: int, lead: int, place: int, length: int) -> list[tuple[int, int]]:
    """Byte spans of a text that the flagged windows cover."""
    at = np.flatnonzero(flags) + place - lead
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > length)
    return [(int(at[i]), int(at[j]) + length) for i, j in zip(np.r_[0, cuts + 1], np.r_[cuts, len(at) - 1], strict=True)]


_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_FOUND = "h long, c long, k1 long, k2 long, p int, m long, runs array<struct<s:int,e:int>>"
_SPAN = "k1 long, k2 long, s int, e int"


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["k1", "k2", "s", "e"])


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in texts), "<i8").reshape(-1, 2)
    return k[:, 0], k[:, 1]


def repeated_spans(rows: DataFrame, length: int = LENGTH, size: int = ANCHOR) -> DataFrame:
    """(k1, k2, spans): for each distinct text of rows(id, text) that has some, by its 128-bit key, the sorted spans (s, e)
    of bytes that recur."""
    lead = length - size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                texts = batch.column("text").slice(lo, 512).to_pylist()
                k1, k2 = _keys(texts)
                for data, start, row, at, h in anchors(texts, length, size):
                    base = int(row[0] - (np.searchsorted(start, at[0], "right") - 1))
                    begin = start[row - base]
                    low, high, around = surroundings(data, begin, start[row - base + 1], at, length, size)
                    # equal surroundings in one text are settled here: one row stands for them and brings their spans
                    order = np.lexsort((at, around, h, row))
                    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1]) & (around[order][1:] == around[order][:-1])
                    first = np.flatnonzero(np.r_[True, ~same])
                    many = np.diff(np.r_[first, len(order)])
                    runs = [None] * len(first)
                    for i in np.flatnonzero(many > 1).tolist():
                        mine = order[first[i] : first[i] + many[i]]
                        spans = zip((low[mine] - begin[mine]).tolist(), (high[mine] - begin[mine]).tolist(), strict=True)
                        runs[i] = [{"s": s, "e": e} for s, e in covered(list(spans), 1 << 31, length)]
                    one = order[first]
                    columns = (h[one].view(np.int64), around[one].view(np.int64), k1[row[one]], k2[row[one]], (at - begin)[one].astype(np.int32), many)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(runs, _RUNS)], names=["h", "c", "k1", "k2", "p", "m", "runs"])

    found = rows.select("text").mapInArrow(find, _FOUND)
    # anchors of a large share of a sample of texts are crowded; there are at most 1 / CROWDED of them
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_OF)) == 0).select("text").mapInArrow(find, _FOUND)
    seen_some = cut(some.groupBy("h").agg(F.sum("m").alias("n")))
    in_all = seen_some.agg(F.sum("n")).first()[0] or 0
    crowded = cut(seen_some.where(F.col("n") > max(in_all * CROWDED, 1)).select("h"))
    crowds = not crowded.isEmpty()
    by_kind, by_anchor = Window.partitionBy("h", "c"), Window.partitionBy("h")
    # one exchange serves all windows; one string stands for all equal surroundings of an anchor
    dealt = (found.join(F.broadcast(crowded), "h", "left_anti") if crowds else found).repartition("h")
    seen = dealt.withColumn("n", F.sum("m").over(by_kind)).withColumn("nth", F.row_number().over(by_kind.orderBy("k1", "k2", "p")))
    seen = seen.withColumn("total", F.sum("m").over(by_anchor)).withColumn("kinds", F.count_if(F.col("nth") == 1).over(by_anchor))
    facts = ["h", "k1", "k2", "p", "runs", "n", "total", "kinds"]
    seen = seen.select(*facts, (F.col("nth") == 1).alias("stands"))
    if crowds:  # partial sums and joins, whose partitions Spark can split, instead of windows
        mass = cut(found.join(F.broadcast(crowded), "h"))
        kinds = cut(mass.groupBy("h", "c").agg(F.sum("m").alias("n"), F.min(F.struct("k1", "k2", "p")).alias("rep")))
        totals = kinds.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        known = mass.join(kinds, ["h", "c"]).join(F.broadcast(totals), "h")
        seen = seen.unionByName(known.select(*facts, (F.struct("k1", "k2", "p") == F.col("rep")).alias("stands")))
    asks = F.col("stands") & (F.col("kinds") > 1)
    marks = seen.where("total > 1").select("k1", "k2", F.when(F.col("n") > 1, F.col("p")).alias("p"), F.when(asks, F.struct("p", "h", (F.col("kinds") > LONG).alias("hot"))).alias("ask"), "runs")
    marked = cut(marks.where("p IS NOT NULL OR ask IS NOT NULL").groupBy("k1", "k2").agg(F.collect_set("p").alias("whole"), F.collect_set("ask").alias("ask"), F.flatten(F.collect_set("runs")).alias("runs")))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, z, at in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "z", "ask")), strict=True):
                text = zstandard.decompress(z)
                rows = [(x["h"], 0, k1, k2, x["p"], min(x["p"], lead), text[max(x["p"] - lead, 0) : x["p"] + length]) for x in at if not x["hot"]]
                columns = list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in range(7)]
                spans = [np.arange(max(x["p"] - lead, 0), min(x["p"] + length, len(text)) - length + 1) for x in at if x["hot"]]
                if spans:  # windows around anchors with very many surroundings, by a 128-bit hash
                    starts = np.unique(np.concatenate(spans))
                    n = len(starts)
                    h, h2 = (xxh64_spans(text, starts, np.full(n, length), seed).view(np.int64).tolist() for seed in (21, 22))
                    for column, x in zip(columns, (h, h2, [k1] * n, [k2] * n, starts.tolist(), [-1] * n, [b""] * n), strict=True):
                        column += x
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["h", "h2", "k1", "k2", "p", "before", "string"])

    def texts_of(asked: DataFrame) -> DataFrame:
        one = packed(rows).drop("id").join(asked, ["k1", "k2"])
        return one.groupBy("k1", "k2").agg(F.first("z").alias("z"), F.first("ask").alias("ask"))  # of copies, one

    asked = texts_of(marked.where(F.size("ask") > 0).select("k1", "k2", "ask"))
    around = asked.mapInArrow(surround, "h long, h2 long, k1 long, k2 long, p int, before int, string binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def run(t: pa.Table) -> pa.RecordBatch:
            strings, before = t.column("string").to_pylist(), t.column("before").to_numpy()
            flags = column_order(strings, before, t.column("h").to_numpy(), length, size)
            out = []
            k1, k2, p = (t.column(x).to_pylist() for x in ("k1", "k2", "p"))
            for i in np.flatnonzero(flags.any(axis=1)).tolist():
                out += [(k1[i], k2[i], s, e) for s, e in _spans(flags[i], 0, lead, p[i], length)]
            return _span_batch(out)

        last: tuple | None = None  # the window before: (h, h2, k1, k2, p, has it been given out)

        def twins(t: pa.Table) -> pa.RecordBatch:
            """Windows that equal the one before or after them; sorted, so nothing else is held."""
            nonlocal last
            rows = list(zip(*(t.column(c).to_pylist() for c in ("h", "h2", "k1", "k2", "p")), strict=True))
            out = []
            for x in rows:
                same = last is not None and last[:2] == x[:2]
                if same and not last[5]:
                    out.append(last)
                if same:
                    out.append(x)
                last = (*x, same)
            return _span_batch([(x[2], x[3], x[4], x[4] + length) for x in out])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            windows = pa.compute.less(t.column("before"), 0)
            if pa.compute.any(windows).as_py():
                yield twins(t.filter(windows))
                t = t.filter(pa.compute.invert(windows))
                if not t.num_rows:
                    continue
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= BATCH:
                h = held.column("h").to_numpy()
                edge = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
                if edge:
                    yield run(held.slice(0, edge))
                    held = held.slice(edge).combine_chunks()
        if held is not None and held.num_rows:
            yield run(held)

    # windows come first in a partition, by their hashes, then surroundings, by their anchors
    spans = around.repartition("h").sortWithinPartitions(F.col("before") >= 0, "h", "h2").mapInArrow(compare, _SPAN)
    more = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("more"))
    whole = F.expr(f"transform(coalesce(whole, cast(array() AS array<int>)), p -> struct(greatest(p - {lead}, 0) AS s, p + {length} AS e))")
    none = F.expr("cast(array() AS array<struct<s:int,e:int>>)")
    both = marked.select("k1", "k2", "whole", "runs").join(more, ["k1", "k2"], "full")
    return both.select("k1", "k2", F.array_sort(F.concat(whole, F.coalesce("runs", none), F.coalesce("more", none))).alias("spans"))


def packed(rows: DataFrame) -> DataFrame:
    """(id, k1, k2, z): texts compressed for the way through a shuffle, by the 128-bit key of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column("text").to_pylist()
            k1, k2 = _keys(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(k1), pa.array(k2), pa.array([squeeze(t) for t in texts], pa.binary())], names=["id", "k1", "k2", "z"])

    return rows.mapInArrow(run, "id long, k1 long, k2 long, z binary")


def covered(spans: list[tuple[int, int]], n: int, length: int) -> list[tuple[int, int]]:
    """The union of sorted spans, cut at the text's end; what is left shorter than a window there holds none."""
    out: list[list[int]] = []
    for s, e in spans:
        e = min(e, n)
        if e - s < length:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _removed(docs: DataFrame, id_col: str, text_col: str, length: int, size: int, with_text: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    found = packed(rows).join(repeated_spans(rows, length, size), ["k1", "k2"], "left").select("id", "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = zstandard.decompress(z)
                gone = covered([(x["s"], x["e"]) for x in spans or []], len(text), length)
                at, kept = 0, []
                for s, e in gone:
                    kept.append(text[at:s])
                    at = e
                rest = b"".join([*kept, text[at:]])
                for column, x in zip(out, (len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest if with_text else None), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int = ANCHOR) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; kept is what is left, as bytes."""
    return _removed(docs, id_col, text_col, length, size, True)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int = ANCHOR) -> DataFrame:
    """As remove_repeats, without the bytes."""
    return _removed(docs, id_col, text_col, length, size, False).drop("kept")
