"""Packing tokenised documents into sequences: cutting-stock column generation over the histogram of piece lengths.

A document of T tokens is cut into T // width full pieces and one rest. The lengths of the rests, in classes of `grain`
tokens, form a histogram of at most width / grain numbers whatever the corpus size; only that histogram reaches the
driver. A linear program over patterns (how many pieces of each class share a sequence) is solved by column generation:
a knapsack dynamic program prices new columns by the program's duals. The patterns' counts are rounded down, what is
left over is filled greedily, and pieces are assigned to pattern slots by their rank in their class.

Ranks are distributed: a class is dealt into salts, each salt is numbered by itself, and the salts' counts (a table of
classes x salts) give where each begins. A length that a third of all rows share is thus split like any other.

Null text is the empty text, which is one piece with only the end token. Repeated rows and ids are packed as they are; a
null id stays null. An empty table gives an empty result. Other columns play no part and may have any name.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

WIDTH = 2048
GRAIN = 8
END_ID = 1
#: Encoded chunks that a worker remembers; a memory of encodings, without influence on results.
MEMORY = 150_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE ids as little-endian 32-bit bytes, with a memory of the chunks that stand between single spaces.

    A space between two non-space characters always begins a new pre-token in this family of vocabularies, so chunks cut
    there are encoded independently; texts with other white-space runs are encoded whole."""

    _runs = regex.compile(r"\s\s|^\s|\s$")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # The file writes each byte as a printable character: visible Latin-1 as itself, the others from U+0100 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and token != "<|endoftext|>"}
        self._encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._first: dict[str, bytes] = {}
        self._next: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text or self._runs.search(text):
            return self._ids(text)
        head, *rest = text.split(" ")
        if len(self._next) > MEMORY:
            self._next.clear()
        known, parts = self._next, [self._ids(head)]
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                ids = self._ids(" " + chunk)
                if len(chunk) < 64:
                    known[chunk] = ids
            parts.append(ids)
        return b"".join(parts)


class TextEncoder:
    """The ids that tokenizers gives for a text: the file's added tokens stand for themselves, what is between them is
    encoded by Encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip white space or are words of their own aren't supported")
        self._encode = Encoder(path)
        self._ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest_first = sorted(self._ids, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None

    def __call__(self, text: str) -> bytes:
        if self._cut is None or not any(t in text for t in self._ids):
            return self._encode(text)
        parts = self._cut.split(text)  # every second part is an added token
        return b"".join(self._ids[x] if i % 2 else self._encode(x) for i, x in enumerate(parts))


@functools.cache
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of every piece. Each document ends with END_ID."""
    path = path or vocabulary()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[], [], [], [], []]
                ids: list[np.ndarray] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = encode(text) + end
                    total = len(raw) // 4
                    for start in range(0, total, width):
                        piece = raw[4 * start : 4 * (start + width)]
                        for column, x in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                            column.append(x)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                arrays = [pa.array(c, pa.int64()) for c in out]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def _price(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern by the unbounded knapsack dynamic program; sizes ascend."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        n = fits[w]
        if n:
            value = best[w - sizes[:n]] + worth[:n]
            i = int(value.argmax())
            if value[i] > best[w - 1]:
                best[w], pick[w] = value[i], i
                continue
        best[w], pick[w] = best[w - 1], -2
    pattern, w = np.zeros(len(sizes)), room
    while w > 0 and pick[w] != -1:
        if pick[w] == -2:
            w -= 1
        else:
            pattern[pick[w]] += 1
            w -= sizes[pick[w]]
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, tolerance: float = 1e-4, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each) of the linear program: fewest sequences that take up all demand."""
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))

    def times(v: np.ndarray) -> np.ndarray:
        """inverse @ v over v's few entries; products this small only suffer from the threads of a linear-algebra library."""
        at = np.flatnonzero(v)
        return (inverse[:, at] * v[at]).sum(axis=1)

    amount = times(demand)
    for n in range(rounds):
        worth = inverse.sum(axis=0)  # every pattern costs one sequence
        value, column = _price(sizes, np.maximum(worth, 0), room)
        # by Farley's bound the optimum is at least sum(amount) / value
        if value <= 1 + tolerance:
            break
        step = times(column)
        up = step > 1e-10
        ratio = np.full(m, np.inf)
        ratio[up] = amount[up] / step[up]
        out = int(ratio.argmin())
        basis[:, out] = column
        if n % 200 == 199:
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
            # one Newton step takes out what rounding has gathered
            error = np.einsum("ij,jk->ik", basis, inverse)
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, error)
        else:
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
        amount = np.maximum(times(demand), 0)
    return basis, amount


def patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """[(pieces of each class in a sequence, number of such sequences)] that take up demand[class] pieces exactly; a piece
    of class c takes up c + 1 grains of a sequence's room."""
    out: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    used = np.flatnonzero(left)
    if len(used):
        columns, amount = column_generation(used + 1, left[used].astype(float), room)
        for j in np.argsort(-amount, kind="stable"):
            column = np.zeros(len(left), np.int64)
            column[used] = np.rint(columns[:, j]).astype(np.int64)
            has = column > 0
            n = int(min(np.floor(amount[j] + 1e-6), (left[has] // column[has]).min())) if has.any() else 0
            if n > 0:
                out.append((column, n))
                left -= column * n
    while left.any():  # what rounding left over: fill sequences with the largest pieces that fit
        column, space = np.zeros(len(left), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            column[c] = min(left[c], space // (c + 1))
            space -= int(column[c]) * (c + 1)
        has = column > 0
        n = int((left[has] // column[has]).min())
        out.append((column, n))
        left -= column * n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, grain: int = GRAIN, path: str | None = None) -> DataFrame:
    """Every piece with its place: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = docs.sparkSession
    cells = cut(pieces(docs, id_col, text_col, width, path).withColumn("class", F.ceil(F.col("length") / grain).cast("int") - 1))
    room = -(-width // grain)
    n = cells.count()
    salts = int(min(1024, max(16, n // 1_000_000)))
    cells = cells.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)).cast("int"))
    counts = np.zeros((room, salts), np.int64)
    for r in cells.groupBy("class", "salt").count().collect():  # at most room x salts rows
        counts[r["class"], r["salt"]] = r["count"]
    base = np.cumsum(counts, axis=1) - counts
    placed, slots, next_id = np.zeros(room, np.int64), [], 0
    for column, times in patterns(counts.sum(axis=1), room):
        for c in np.flatnonzero(column).tolist():
            each = int(column[c])
            slots.append((c, int(placed[c]), int(placed[c]) + each * times, each, next_id))
            placed[c] += each * times
        next_id += times
    bases = spark.createDataFrame([(c, s, int(base[c, s])) for c, s in np.argwhere(counts).tolist()], "class int, salt int, base long")
    slots_df = spark.createDataFrame(slots, "slot_class int, lo long, hi long, each long, first long")
    in_salt = F.row_number().over(Window.partitionBy("class", "salt").orderBy("id", "start"))
    ranked = cells.withColumn("nth", in_salt - 1).join(F.broadcast(bases), ["class", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    # both small tables are bounded by room and salts, whatever the corpus
    on = (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed_df = ranked.join(F.broadcast(slots_df), on).withColumn("sequence_id", F.col("first") + F.expr("(rank - lo) div each"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")
    return placed_df.withColumn("offset", offset).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, path: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed token ids by a plan that pack() gave for the same docs; ids must be unique."""
    parts = pieces(docs, id_col, text_col, width, path, with_ids=True).withColumnRenamed("id", id_col)
    placed = parts.join(plan.select(id_col, "start", "sequence_id", "offset"), [id_col, "start"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most width pieces
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
