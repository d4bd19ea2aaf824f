"""Spelling variants: words one edit apart, found by merging the light subtrees of an errata trie.

Words are sorted by range, so a partition holds a contiguous piece of the trie of all words. At each branching node the
child with most words is heavy, all others are light, and so is a word's end. Each word under a light child is put into the
merged subtree with that child's character skipped, replaced by the heavy one, or preceded by it; words of two light
children meet with their characters replaced by a wildcard. Where a terminal coincides with a word's, the two are one edit
apart. Only light subtrees are walked, the small into the large, so a word is put in once for each light edge above it, of
which there are at most log2 of the words.

Two words that are one edit apart part at one node, and are found there once: if the longer one's character is light, by
skipping it (unless the next one is the same, for then they part further down); if it is heavy, the shorter one's is light
and finds it by insertion; replaced characters are found from the light side, or between two light ones.

Nodes whose words all lie in one partition are merged there. What remains are the nodes on the paths of a partition's first
and last word: their counts are added up over partitions, and the terminals of their light children meet the words in a
join. At most two paths a partition go to the driver for that, and of these only nodes that branch.

Null texts hold no words; null ids count as empty in the hash. Repeated rows count each. Empty tables give empty results.
Other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Stands for any character in a merged terminal; no word holds it.
ANY = "\0"
_PAIR = pa.schema([("kind", pa.int8()), ("key", pa.string()), ("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])
_ROWS = 100_000


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, typo: int = 31) -> DataFrame:
    """(word, n): maximal runs of ASCII and Latin-1 letters, A-Z in lower case, with at least so many code points.

    A run loses the code point h % length if `typo` divides h, the crc32 of '<id>:<run>'; typo = 0 leaves runs alone."""
    find = re.compile(f"[a-zÀ-ÿ]{{{max(1, least)},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(find(text.lower().decode("utf-8", "replace"))).items():  # bytes: only A-Z change
                    if typo and (h := zlib.crc32(f"{'' if i is None else i}:{word}".encode())) % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield passed()
                    held = Counter()
        if held:
            yield passed()

    rows = docs.select(F.col(f"`{id_col}`").cast("string"), text_or_empty(text_col).cast("binary"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Piece:
    """One partition's words, in order, with what they share with their neighbours."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.words: list[str] = []
        self.n: list[int] = []
        for b in batches:
            self.words += b.column(0).to_pylist()
            self.n += b.column(1).to_pylist()
        w = self.words
        self.common = np.fromiter((_shared(a, b) for a, b in zip(w, w[1:], strict=False)), np.int64, max(0, len(w) - 1))

    def paths(self) -> Iterator[tuple[int, int, int, str]]:
        """(depth, from, to, its word): the nodes above the first and above the last word, once each."""
        if not self.words:
            return
        first, last, m = self.words[0], self.words[-1], len(self.words)
        with_first = np.minimum.accumulate(self.common)  # of first and word i + 1; never grows
        with_last = np.minimum.accumulate(self.common[::-1])[::-1]  # of word i and last; never falls
        both = int(with_first[-1]) if m > 1 else len(first)
        for d in range(len(first) + 1):
            yield d, 0, 1 + int(np.searchsorted(-with_first, -d, "right")), first
        for d in range(both + 1, len(last) + 1 if m > 1 else 0):
            yield d, int(np.searchsorted(with_last, d, "left")), m, last

    def children(self, d: int, a: int, b: int) -> list[tuple[str, int, int]]:
        """(character or '' for a word's end, from, to) below the node of depth d that holds the words a to b."""
        cuts = [a, *(np.flatnonzero(self.common[a : b - 1] == d) + a + 1).tolist(), b]
        return [(self.words[x][d : d + 1], x, y) for x, y in zip(cuts, cuts[1:], strict=False)]

    def inner(self) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
        """(depth, children) of the branching nodes that hold neither the first nor the last word."""
        stack: list[tuple[int, int, list[int]]] = []
        m = len(self.words)
        for i, h in enumerate([*self.common.tolist(), -1], 1):
            left = i - 1
            while stack and stack[-1][0] > h:
                d, left, cuts = stack.pop()
                if left and i < m:
                    edges = [left, *cuts, i]
                    yield d, [(self.words[x][d : d + 1], x, y) for x, y in zip(edges, edges[1:], strict=False)]
            if stack and stack[-1][0] == h:
                stack[-1][2].append(i)
            elif h >= 0:
                stack.append((h, left, [i]))


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is shared, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _node_ids(word: str) -> list[bytes]:
    """An id for each beginning of word, the empty one first, in one pass."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for c in word:
        h.update(c.encode())
        out.append(h.digest())
    return out


def _merge(words: list[str], d: int, heavy: str, light: list[tuple[str, int, int]], put: Callable[[str, int], None], wild: Callable[[str, int], None]) -> None:
    """Puts the words under light children into the subtree merged at depth d: put(terminal, word's number), wild likewise."""
    for c, a, b in light:
        for i in range(a, b):
            w = words[i]
            start, rest = w[:d], w[d + 1 :]
            put(start + heavy + w[d:], i)  # the heavy character before it
            if c:
                put(start + heavy + rest, i)  # in its place
                wild(start + ANY + rest, i)
                if rest[:1] != c:
                    put(start + rest, i)  # skipped


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words(word, n) that are one inserted, deleted or replaced code point apart, once."""
    placed = cut(words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, ids = _Piece(batches), {}
        rows = []
        for d, a, b, word in piece.paths():
            if word not in ids:
                ids = {word: _node_ids(word)}
            rows += [(ids[word][d], c, y - x) for c, x, y in piece.children(d, a, b)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["node", "c", "n"])

    counts = placed.mapInArrow(paths, "node binary, c string, n long").groupBy("node", "c").agg(F.sum("n").alias("n"))
    branching = counts.groupBy("node").agg(F.count("*").alias("kids"), F.min_by("c", F.when(F.col("c") != "", F.struct(-F.col("n"), F.col("c")))).alias("heavy")).where("kids > 1")
    # two paths a partition at most, whatever the number of words
    heavy = placed.sparkSession.sparkContext.broadcast({bytes(r.node): r.heavy for r in branching.toLocalIterator()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _Piece(batches)
        words, n, rows = piece.words, piece.n, []
        at = {w: i for i, w in enumerate(words)}

        def full(least: int) -> Iterator[pa.RecordBatch]:
            if len(rows) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PAIR, strict=True)], schema=_PAIR)
                rows.clear()

        def pair(terminal: str, i: int) -> None:
            j = at.get(terminal)
            if j is not None:
                rows.append((2, None, words[i], n[i], words[j], n[j]))

        for d, kids in piece.inner():
            h = min((a - b, c) for c, a, b in kids if c)[1]
            met: dict[str, list[int]] = defaultdict(list)

            def meet(terminal: str, i: int, met: dict[str, list[int]] = met) -> None:
                for j in met[terminal]:  # one for each other character at most
                    rows.append((2, None, words[i], n[i], words[j], n[j]))
                met[terminal].append(i)

            _merge(words, d, h, [k for k in kids if k[0] != h], pair, meet)
            yield from full(_ROWS)
        ids: dict[str, list[bytes]] = {}
        for d, a, b, word in piece.paths():
            if word not in ids:
                ids = {word: _node_ids(word)}
            h = heavy.value.get(ids[word][d])
            if h is not None:
                for k in piece.children(d, a, b):
                    if k[0] != h:
                        _merge(words, d, h, [k], lambda t, i: rows.append((0, t, words[i], n[i], None, None)), lambda t, i: rows.append((1, t, words[i], n[i], None, None)))
                        yield from full(_ROWS)
        yield from full(1)

    found = cut(placed.mapInArrow(merge, "kind byte, key string, a string, na long, b string, nb long"))
    inside = found.where("kind = 2").select("a", "na", "b", "nb")
    over = found.where("kind = 0").select("key", "a", "na").join(placed.select(F.col("word").alias("key"), F.col("n").alias("nb")), "key").select("a", "na", F.col("key").alias("b"), "nb")
    # one word for each character at most
    alike = found.where("kind = 1").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "na"))).alias("w")).where(F.size("w") > 1)
    two = alike.select("w", F.posexplode("w").alias("i", "x")).select("x", F.explode(F.expr("slice(w, i + 2, size(w))")).alias("y")).select("x.a", "x.na", F.col("y.a").alias("b"), F.col("y.na").alias("nb"))
    return inside.unionByName(over).unionByName(two)


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of words(word, n).

    form is the near word of largest n (ties: the first in code-point order) if its n is at least factor times the word's,
    else null. root is where forms lead to; n grows by the factor at each step, so a path has at most log n steps."""
    if factor < 2:
        raise ValueError("with a factor under 2, forms might lead in circles")
    held = cut(words.select("word", "n"))
    pairs = near_pairs(held)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("x")).select("x.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), F.col("other"))).alias("best"))
    form = F.when(F.col("best.m") >= factor * F.col("n"), F.col("best"))
    near = cut(held.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.getField("other").alias("form"), form.getField("m").alias("form_n")))
    leads = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a row has gone
        ahead = leads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        gone = cut(leads.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        leads = gone.select("word", "root")
        if gone.where("moved").isEmpty():
            break
    return near.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, typo: int = 31, occurrences: int = 2, factor: int = 10) -> DataFrame:
    """variants() of the words of docs that occur at least so often."""
    return variants(counted_words(docs, id_col, text_col, least, typo).where(F.col("n") >= occurrences), factor)
