"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text's segmentations are the paths through the lattice of vocabulary pieces. A path's probability is the product of its
pieces' weights, exp(alpha * score), over the total of all paths, which a backward pass gives exactly. The perturbed value
of a path is its log-probability plus Gumbel noise; the k paths with the largest values are a sample without replacement.

They are found by A-star search over prefixes. The bound of a set of paths is the largest perturbed value in it: a Gumbel
number at the log of the set's mass, truncated at the value of the set it was split from. The best path inherits the
bound of its set, so a search step takes the best open set, draws the path that attains its bound, and splits the rest of
the set by the place where other paths leave it. All of this is done for all texts of a block at once.

Random numbers are hashes of (row key, sample, place, step), so samples depend on the row alone. A sample's inclusion
score is the probability that its value exceeds the (k+1)-th largest, 1 - exp(-exp(log_prob - kappa)), given as its
logarithm, since long texts' segmentations are too unlikely for a double.

Null text is the empty text; its one segmentation has no pieces. Texts with fewer than k segmentations give them all, with
log-inclusion 0. Null keys count as key 0. Repeated rows give equal samples. An empty table gives an empty result.
Other columns play no part in encode() and may have any name; decode() replaces a column `decoded`.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, text_or_empty

K = 2
#: Units whose lattices a worker remembers; without influence on results.
MEMORY = 150_000
ALPHA = 0.0002
SPACE = "▁"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) by mixing integers; a hash, not a stream."""
    with np.errstate(over="ignore"):
        z = np.uint64(0)
        for p in parts:
            z = (z ^ np.asarray(p).astype(np.uint64)) + _GOLD
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces by the hash of their characters, with all their beginnings, in one sorted table."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        known = {sp.id_to_piece(i): i for i in range(n) if not sp.is_byte(i) and i not in special}
        self.text_of = {i: p.encode() for p, i in known.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        # some single characters are scored far below all ranks; they count as the lowest rank
        self.log_weight = np.array([alpha * max(sp.get_score(i), -float(n)) for i in range(n)])
        self.byte_weight = float(self.log_weight.min())
        table: dict[int, int] = {}
        for p, i in known.items():
            h = self.hashes(np.array([ord(c) for c in p], np.uint64))
            for x in h[:-1].tolist():
                table.setdefault(x, -1)
            table[int(h[-1])] = i
        self.keys = np.array(sorted(table), np.uint64)
        self.ids = np.array([table[int(x)] for x in self.keys], np.int64)
        self.longest = max(map(len, known))
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in known)

    @staticmethod
    def step(h: np.ndarray, char: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (char + np.uint64(0x1F123BB5))) * _BASE
            return h ^ (h >> np.uint64(29))

    def hashes(self, chars: np.ndarray) -> np.ndarray:
        out, h = np.empty(len(chars), np.uint64), np.uint64(0xCBF29CE484222325)
        for i, c in enumerate(chars):
            h = self.step(h, c)
            out[i] = h
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is the beginning of a piece, the piece's id or -1)."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        ok = self.keys[at] == h
        return ok, np.where(ok, self.ids[at], -1)


@functools.cache
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


# No piece holds a space after another character, and a line feed is in no piece: segmentations of these units are
# independent of each other.
_unit = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


def units(text: str) -> list[str]:
    return _unit.findall(SPACE + text.replace(" ", SPACE)) if text else []


@dataclass
class Lattice:
    """The lattices of many different units: nodes are characters, edges are pieces, ordered by node."""

    root: np.ndarray  # by unit: its first node
    first: np.ndarray  # by node: its first edge; one more at the end
    target: np.ndarray  # by edge: the node it leads to, -1 at the unit's end
    piece: np.ndarray  # by edge: the id; -1 - code point for a character that only bytes spell
    log_p: np.ndarray  # by edge: its log-probability, given its node
    cum: np.ndarray  # by edge: the probability of it and the edges before it at its node
    rest: np.ndarray  # by edge: the probability of the others at its node
    node: np.ndarray  # by edge: where it begins

    def others(self, edge: np.ndarray, barred: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(edges, probabilities) at each edge's node as matrices, with 0 for it, for barred ones and beyond the node."""
        node = self.node[edge]
        low, high = self.first[node], self.first[node + 1]
        edges = low[:, None] + np.arange(int((high - low).max(initial=1)))
        p = np.where(edges < high[:, None], np.exp(self.log_p[np.minimum(edges, len(self.log_p) - 1)]), 0.0)
        for b in [edge, *barred]:
            p[edges == b[:, None]] = 0.0
        return edges, p


def build(names: list[str], v: Vocabulary) -> Lattice:
    length = np.array([len(u) for u in names], np.int64)
    chars = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").astype(np.uint64)
    end = np.cumsum(length)
    n = len(chars)
    left = np.repeat(end, length) - np.arange(n)  # characters to the unit's end
    sources, targets, pieces = [], [], []
    alive, h = np.arange(n), np.full(n, 0xCBF29CE484222325, np.uint64)
    has_single = np.zeros(n, bool)
    for size in range(1, v.longest + 1):
        inside = left[alive] >= size
        alive, h = alive[inside], h[inside]
        if not len(alive):
            break
        h = v.step(h, chars[alive + size - 1])
        ok, ids = v.find(h)
        full = ids >= 0
        sources.append(alive[full])
        targets.append(alive[full] + size)
        pieces.append(ids[full])
        if size == 1:
            has_single[alive[full]] = True
        alive, h = alive[ok], h[ok]
    bare = np.flatnonzero(~has_single)
    sources.append(bare)
    targets.append(bare + 1)
    pieces.append(-1 - chars[bare].astype(np.int64))
    # by node, the longest piece first, which mostly is the likeliest; the parts ascend, so this is a merge
    source, target, piece = (np.concatenate(x[::-1]) for x in (sources, targets, pieces))
    order = np.argsort(source, kind="stable")
    source, target, piece = source[order], target[order], piece[order]
    first = np.r_[0, np.cumsum(np.bincount(source, minlength=n))]
    code = np.maximum(-1 - piece, 0)
    n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    weight = np.where(piece >= 0, v.log_weight[np.maximum(piece, 0)], v.byte_weight * n_bytes)
    # backward: total weight from each node to its unit's end, nodes with fewest characters left first
    beta = np.zeros(n + 1)
    remaining = left[source]
    order = np.argsort(remaining.astype(np.uint16) if remaining.max() < 1 << 16 else remaining, kind="stable")
    s, t, w = source[order], target[order], weight[order]
    remaining = left[s]
    cuts = np.r_[0, np.flatnonzero(np.diff(remaining)) + 1, len(s)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ss, val = s[a:b], w[a:b] + np.where(left[s[a:b]] == t[a:b] - s[a:b], 0.0, beta[t[a:b]])
        starts = np.r_[0, np.flatnonzero(np.diff(ss)) + 1]
        beta[ss[starts]] = np.logaddexp.reduceat(val, starts)
    last = left[source] == target - source
    log_p = np.minimum(weight + np.where(last, 0.0, beta[target]) - beta[source], 0.0)
    p = np.exp(log_p)
    total = np.cumsum(p)
    cum = total - np.r_[0.0, total][first[source]]
    cum[first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
    rest = 1.0 - p  # exact enough, but for the likely ones
    likely = np.flatnonzero(p > 0.5)  # at most one a node
    q = p.copy()
    q[likely] = 0.0
    rest[likely] = np.add.reduceat(q, first[:-1])[source[likely]]
    return Lattice(end - length, first, np.where(last, -1, target).astype(np.int32), piece.astype(np.int32), log_p, cum, rest, source.astype(np.int32))


class Memory:
    """The lattices of the units that came first, and behind them, in the same arrays, those that a block adds."""

    def __init__(self, v: Vocabulary):
        self.v, self.names, self.nodes, self.edges = v, {}, 0, 0
        kinds = {f: np.int32 for f in ("target", "piece", "node")} | {f: np.float64 for f in ("log_p", "cum", "rest")} | {f: np.int64 for f in ("root", "first")}
        self.arrays = {f: np.zeros(1, t) for f, t in kinds.items()}

    def _put(self, name: str, at: int, values: np.ndarray) -> np.ndarray:
        """The array up to the end of values, which now stand at `at`."""
        end = at + len(values)
        if end > len(self.arrays[name]):
            wider = np.zeros(end + end // 4, self.arrays[name].dtype)
            wider[:at] = self.arrays[name][:at]
            self.arrays[name] = wider
        self.arrays[name][at:end] = values
        return self.arrays[name][:end]

    def lookup(self, split: list[list[str]]) -> tuple[Lattice, np.ndarray]:
        """(lattice, the number in it of each unit of the texts)."""
        known, fresh, n = self.names, {}, len(self.names)
        flat = np.array([known[u] if u in known else fresh.setdefault(u, n + len(fresh)) for s in split for u in s], np.int64)
        more = build(list(fresh), self.v) if fresh else EMPTY
        shifted = {"root": more.root + self.nodes, "first": more.first + self.edges, "target": np.where(more.target < 0, -1, more.target + self.nodes), "piece": more.piece, "log_p": more.log_p, "cum": more.cum, "rest": more.rest, "node": more.node + self.nodes}
        at = {"root": n, "first": self.nodes} | {f: self.edges for f in ("target", "piece", "log_p", "cum", "rest", "node")}
        lattice = Lattice(**{f: self._put(f, at[f], x) for f, x in shifted.items()})
        if n + len(fresh) <= MEMORY:
            self.names |= fresh
            self.nodes, self.edges = self.nodes + len(more.first) - 1, self.edges + len(more.node)
        return lattice, flat


EMPTY = Lattice(np.zeros(0, np.int64), np.zeros(1, np.int64), *[np.zeros(0, np.int32)] * 2, *[np.zeros(0)] * 3, np.zeros(0, np.int32))


@dataclass
class Path:
    """One segmentation of each text of a block: its decisions in order, flat over the texts."""

    unit: np.ndarray  # by decision: the place of its unit in the block
    step: np.ndarray
    edge: np.ndarray
    start: np.ndarray  # by text: its first decision; one more at the end
    bound: np.ndarray  # by decision: the largest value among paths that leave here, or -inf
    value: np.ndarray  # by text: the path's own perturbed value, -inf if the text has no such path
    branch: np.ndarray  # by text: the decision where it left an earlier path, or -1
    barred: list[np.ndarray]  # by text: edges that paths leaving at `branch` must not take


def _bounds(lat: Lattice, path: Path, keys: np.ndarray, local: np.ndarray, sample: int) -> None:
    """Fill in bound. Decisions before the branch can't be left again: their sets belong to earlier paths.

    A random number is at least 2**-54, so no bound exceeds its set's log-mass by more than 37.5. Decisions whose prefix
    is less likely than exp(-80) are thus looked at only where nothing before reached -42."""
    n = np.diff(path.start)
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    log_p = lat.log_p[path.edge]
    total = np.cumsum(log_p) - log_p
    before = total - np.repeat(total[np.minimum(path.start[:-1], max(len(total) - 1, 0))], n) if len(total) else total
    bound = path.bound = np.full(len(text), -np.inf)
    alive = (np.arange(len(text)) >= path.branch[text]) & np.isfinite(path.value[text])
    left = np.flatnonzero(path.branch >= 0)

    def fill(at: np.ndarray) -> None:
        edge = path.edge[at]
        rest = lat.rest[edge]
        if len(left):
            where = np.searchsorted(at, path.branch[left])
            ok = where < len(at)
            ok[ok] = at[where[ok]] == path.branch[left][ok]
            rest[where[ok]] = lat.others(path.edge[path.branch[left[ok]]], [b[left[ok]] for b in path.barred])[1].sum(axis=1)
        own = np.flatnonzero((lat.first[lat.node[edge] + 1] - lat.first[lat.node[edge]] > 1) & (rest > 0))
        at = at[own]
        mass = before[at] + np.log(rest[own])
        noise = -np.log(uniform(keys[text[at]], 1000 + sample, local[path.unit[at]], path.step[at]))
        # a Gumbel number at `mass`, truncated at the path's value
        bound[at] = -np.logaddexp(-path.value[text[at]], np.log(noise) - mass)

    near = before >= -80
    fill(np.flatnonzero(alive & near))
    has = np.flatnonzero(n > 0)
    reached = np.zeros(len(n), bool)
    if len(has):
        reached[has] = np.maximum.reduceat(bound, path.start[has]) >= -42
    rest_of = np.flatnonzero(alive & ~near & ~reached[text])
    if len(rest_of):
        fill(rest_of)


def sample_block(texts: list[str], keys: np.ndarray, k: int, memory: Memory) -> tuple[Lattice, list[Path], np.ndarray]:
    """k samples of each text, best first, and the value of the next one, kappa."""
    split = [units(t) for t in texts]
    count = np.array([len(s) for s in split], np.int64)
    lat, flat = memory.lookup(split)
    first_unit = np.r_[0, np.cumsum(count)]
    text_of = np.repeat(np.arange(len(texts)), count)
    local = np.arange(len(flat)) - np.repeat(first_unit[:-1], count)
    m = len(texts)

    def free(which: np.ndarray, node: np.ndarray, step: np.ndarray, sample: int):
        """(unit, step, edge) of free draws from the nodes on to the units' ends. The random numbers depend on a unit's place
        in its own text, not in the block."""
        out, place = [], which
        while len(place):
            u = uniform(keys[text_of[place]], sample, local[place], step)
            e = lat.first[node].copy()
            go = np.flatnonzero(lat.cum[e] <= u)
            while len(go):
                e[go] += 1
                go = go[lat.cum[e[go]] <= u[go]]
            out.append((place, step, e))
            to = lat.target[e]
            on = np.flatnonzero(to >= 0)
            place, node, step = place[on], to[on], step[on] + 1
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3

    def ordered(unit: np.ndarray, step: np.ndarray, edge: np.ndarray, value: np.ndarray, branch_at: np.ndarray | None, barred: list[np.ndarray]) -> Path:
        order = np.lexsort((step, unit))
        unit, step, edge = unit[order], step[order], edge[order]
        start = np.searchsorted(text_of[unit], np.arange(m + 1)) if len(unit) else np.zeros(m + 1, np.int64)
        branch = np.full(m, -1) if branch_at is None else np.where(branch_at >= 0, start[:-1] + branch_at, -1)
        return Path(unit, step, edge, start, np.zeros(0), value, branch, barred)

    value = -np.log(-np.log(uniform(keys, 0, 0, 1 << 40)))
    every = np.arange(len(flat))
    path = ordered(*free(every, lat.root[flat], np.zeros(len(flat), np.int64), 0), value, None, [])
    _bounds(lat, path, keys, local, 0)
    paths = [path]
    for sample in range(1, k + 1):
        # the best open set of each text, over all paths so far
        best, of, at = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for p, path in enumerate(paths):
            has = np.flatnonzero(np.diff(path.start) > 0)
            if not len(has):
                continue
            top = np.maximum.reduceat(path.bound, path.start[has])
            better = top > best[has]
            rows = has[better]
            best[rows], of[rows] = top[better], p
        if sample == k:
            break  # of the next path only the value counts
        for p, path in enumerate(paths):
            rows = np.flatnonzero((of == p) & np.isfinite(best))
            text = np.repeat(np.arange(m), np.diff(path.start))
            hit = np.flatnonzero(path.bound == best[text]) if len(text) else np.zeros(0, np.int64)
            hit = hit[of[text[hit]] == p]
            at[text[hit][::-1]] = hit[::-1]
            path.bound[at[rows]] = -np.inf
        found = np.isfinite(best)
        parts, branch_at = [], np.full(m, -1, np.int64)
        barred = [np.full(m, -1, np.int64) for _ in range(sample)]
        new_edge, new_unit, new_step = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for p, path in enumerate(paths):
            rows = np.flatnonzero((of == p) & found)
            if not len(rows):
                continue
            i = at[rows]
            barred[0][rows] = path.edge[i]
            for q, old in enumerate(path.barred):  # left again where it had branched: what was barred there stays so
                again = path.branch[rows] == i
                barred[q + 1][rows[again]] = old[rows[again]]
            new_unit[rows], new_step[rows], branch_at[rows] = path.unit[i], path.step[i], i - path.start[rows]
            # decisions before the branch are copied
            text = np.repeat(np.arange(m), np.diff(path.start))
            mine = np.zeros(m, np.int64)
            mine[rows] = i
            keep = np.flatnonzero(np.arange(len(text)) < mine[text])
            parts.append((path.unit[keep], path.step[keep], path.edge[keep]))
            # the new edge: one of the others at this node, by its share of what isn't barred
            edges, share = lat.others(path.edge[i], [b[rows] for b in barred])
            run = np.cumsum(share, axis=1)
            pick = uniform(keys[rows], 2000 + sample, local[path.unit[i]], path.step[i])[:, None] * run[:, -1:]
            j = np.minimum((run <= pick).sum(axis=1), edges.shape[1] - 1)
            zero = share[np.arange(len(rows)), j] <= 0
            j[zero] = share[zero].argmax(axis=1)
            new_edge[rows] = edges[np.arange(len(rows)), j]
        rows = np.flatnonzero(found)
        parts.append((new_unit[rows], new_step[rows], new_edge[rows]))
        to = lat.target[new_edge[rows]] if len(rows) else np.zeros(0, np.int64)
        on = to >= 0
        later = every[found[text_of] & (every > new_unit[text_of])] if len(flat) else every
        places = np.r_[new_unit[rows][on], later]
        nodes = np.r_[to[on], lat.root[flat[later]]].astype(np.int64)
        steps = np.r_[new_step[rows][on] + 1, np.zeros(len(later), np.int64)]
        parts.append(tuple(free(places, nodes, steps, sample)))
        unit, step, edge = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        path = ordered(unit, step, edge, best, branch_at, barred)
        _bounds(lat, path, keys, local, sample)
        paths.append(path)
    return lat, paths, best


@functools.cache
def memory_of(path: str, alpha: float) -> Memory:
    """One for all tasks of a worker."""
    return Memory(vocabulary(path, alpha))


def piece_ids(lat: Lattice, path: Path, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each text's begin): characters that only bytes spell become their bytes' ids."""
    piece = lat.piece[path.edge]
    bare = np.flatnonzero(piece < 0)
    start = path.start
    if len(bare):
        spelled = [[v.bytes[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")] for x in piece[bare].tolist()]
        n = np.ones(len(piece), np.int64)
        n[bare] = [len(s) for s in spelled]
        where = np.r_[0, np.cumsum(n)]
        ids = np.repeat(piece, n)
        ids[np.concatenate([where[b] + np.arange(len(s)) for b, s in zip(bare.tolist(), spelled, strict=True)])] = np.concatenate(spelled)
        return ids, where[start]
    return piece, start


def decode_ids(ids: list[int] | np.ndarray, v: Vocabulary) -> str:
    known = v.text_of
    raw = b"".join([known[i] for i in np.asarray(ids, np.int64).tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
    return raw.removeprefix(" ")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, alpha: float = ALPHA, path: str | None = None, with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """(id_col, sample, n_pieces, ids_crc32, log_prob, value, log_inclusion[, ids][, decoded_bytes, decoded_crc32]): up to k
    distinct segmentations of every text, best first. ids_crc32 is over little-endian 32-bit ids; decoded_bytes and
    decoded_crc32 are of the text, in UTF-8, that the ids spell."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        memory = memory_of(path, alpha)
        for batch in batches:
            all_ids, raw = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_blocks(raw, 1_000_000):
                texts = [t.decode("utf-8", "replace") for t in raw[a:b]]
                own = all_ids.slice(a, b - a)
                keys = np.array([x or 0 for x in own.to_pylist()], np.int64).astype(np.uint64)
                lat, paths, kappa = sample_block(texts, keys, k, memory)
                for s, p in enumerate(paths):
                    ids, start = piece_ids(lat, p, v)
                    data = ids.astype("<u4").tobytes()
                    log_p = np.r_[0.0, np.cumsum(lat.log_p[p.edge])]
                    log_prob = log_p[p.start[1:]] - log_p[p.start[:-1]]
                    with np.errstate(over="ignore"):
                        x = np.where(np.isfinite(kappa), np.clip(log_prob - kappa, None, 30.0), 30.0)
                        log_inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.maximum(x, -30.0)))))
                    keep = np.isfinite(p.value)
                    rows = np.flatnonzero(keep)
                    columns = [
                        own.take(pa.array(rows)),
                        pa.array(np.full(len(rows), s + 1), pa.int64()),
                        pa.array(np.diff(start)[rows], pa.int64()),
                        pa.array([zlib.crc32(data[4 * start[i] : 4 * start[i + 1]]) for i in rows], pa.int64()),
                        pa.array(log_prob[rows]),
                        pa.array(p.value[rows]),
                        pa.array(log_inclusion[rows]),
                    ]
                    names = ["id", "sample", "n_pieces", "ids_crc32", "log_prob", "value", "log_inclusion"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(ids, pa.int32())).take(pa.array(rows)))
                        names.append("ids")
                    if with_decoded:
                        spelled = [decode_ids(ids[start[i] : start[i + 1]], v).encode("utf-8", "surrogatepass") for i in rows]
                        columns += [pa.array([len(x) for x in spelled], pa.int64()), pa.array([zlib.crc32(x) for x in spelled], pa.int64())]
                        names += ["decoded_bytes", "decoded_crc32"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    schema = "id long, sample long, n_pieces long, ids_crc32 long, log_prob double, value double, log_inclusion double" + ", ids array<int>" * with_ids + ", decoded_bytes long, decoded_crc32 long" * with_decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with a column `decoded`, the text that the ids spell; null ids give null."""
    path = path or model_path()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path, ALPHA)
        for ids in batches:
            yield pd.Series([None if x is None else decode_ids(x, v) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text(F.col(ids_col)))
