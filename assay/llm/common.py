"""Helpers that the training-data operators share: cut lineage, column selection, vectorised XXH64."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as the empty text, everywhere in this subpackage."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, as in tests, a local one, but never on a cluster."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="assay-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder in spark.checkpoint.dir, so that a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _same_length(at64: np.ndarray, at32: np.ndarray, at8: np.ndarray, s: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of the spans that begin at s and are all of one length."""
    with np.errstate(over="ignore"):
        p, k = s.copy(), length
        if length >= 32:
            acc = [np.full(len(s), x, np.uint64) for x in (np.uint64(seed) + _P1 + _P2, np.uint64(seed) + _P2, np.uint64(seed), np.uint64(seed) - _P1)]
            while k >= 32:
                for i in range(4):
                    acc[i] = _round(acc[i], at64[p + 8 * i])
                p, k = p + 32, k - 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for x in acc:
                h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
        else:
            h = np.full(len(s), np.uint64(seed) + _P5, np.uint64)
        h += np.uint64(length)
        while k >= 8:
            h = _rotl(h ^ _round(np.zeros_like(h), at64[p]), 27) * _P1 + _P4
            p, k = p + 8, k - 8
        if k >= 4:
            h = _rotl(h ^ (at32[p].astype(np.uint64) * _P1), 23) * _P2 + _P3
            p, k = p + 4, k - 4
        for i in range(k):
            h = _rotl(h ^ (at8[p + i].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def xxh64_spans(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each data[start : start + length], vectorised over the spans of equal length."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    buf = np.frombuffer(data + bytes(8), np.uint8)
    n = len(buf) - 8
    at64 = np.ndarray((n + 1,), "<u8", buf, strides=(1,))
    at32 = np.ndarray((n + 1,), "<u4", buf, strides=(1,))
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    edges = np.flatnonzero(np.diff(sorted_lengths)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, len(order)], strict=True):
        i = order[a:b]
        out[i] = _same_length(at64, at32, buf, starts[i], int(sorted_lengths[a]), seed)
    return out


class Words:
    """The words of many texts in one buffer, and their shingles of k words with one space between.

    ASCII lower case; words are runs of anything but the six ASCII white-space bytes."""

    def __init__(self, texts: list[bytes], k: int):
        rows = [b" ".join(t.lower().split()) for t in texts]
        self.data = b" ".join(rows)
        self.n_words = np.array([r.count(b" ") + 1 if r else 0 for r in rows], np.int64)
        size = np.array([len(r) for r in rows], np.int64)
        row_start = np.r_[0, np.cumsum(size + 1)[:-1]].astype(np.int64)
        raw = np.frombuffer(self.data, np.uint8)
        gap = np.flatnonzero(raw == 32)
        # An empty row leaves a space with no word before it; keep only starts where a word stands.
        starts = np.r_[0, gap + 1] if len(rows) else np.zeros(0, np.int64)
        ends = np.r_[gap, len(raw)] if len(rows) else np.zeros(0, np.int64)
        full = ends > starts
        self.starts, self.ends = starts[full].astype(np.int64), ends[full].astype(np.int64)
        self.first_word = np.r_[0, np.cumsum(self.n_words)[:-1]].astype(np.int64)
        #: fewer words than k: the whole sequence is the one shingle
        self.n_shingles = np.where(self.n_words >= k, self.n_words - k + 1, np.minimum(self.n_words, 1))
        self.k, self.row_start = k, row_start

    def row_hashes(self, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, hashes): the shingle hashes of row i are hashes[offsets[i]:offsets[i+1]]."""
        offsets = np.r_[0, np.cumsum(self.n_shingles)].astype(np.int64)
        row = np.repeat(np.arange(len(self.n_words)), self.n_shingles)
        w = self.first_word[row] + np.arange(offsets[-1]) - offsets[:-1][row]
        last = np.minimum(w + self.k - 1, self.first_word[row] + self.n_words[row] - 1)
        s = self.starts[w]
        return offsets, xxh64_spans(self.data, s, self.ends[last] - s, seed)


def text_blocks(texts: list[bytes], limit: int = 4_000_000):
    """Index ranges of consecutive texts of about limit bytes each, so that numpy buffers stay small."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
