"""Toxicity: a linear classifier whose fit penalises score changes under swaps of identity terms.

Features are the words of a text and word beginnings of 4 to 7 letters. Which of them enter the model is decided by
their counts in toxic and other labelled texts. Each labelled sentence that holds an identity term has counterfactual
twins with another term of the same kind in its place; the fit adds `fairness` times the mean squared change of the logit
between twins, so that the mention of a term by itself moves a score little.

Identity terms are those of IDENTITY and terms learned from the labelled rows: words that stand in toxic and in other
texts about equally often, so that nothing speaks for a meaning of their own, and that are interchangeable, which is to say
that they mostly follow the same word.

The fit takes a sample of at most about SAMPLE labelled rows, chosen by a hash of the id; scoring covers every row.

Null text is the empty text and gets the score of a text without known features. Rows without id or label don't take
part in the fit; without labelled rows of both kinds every score is 0.5. An empty table gives an empty result, and other
columns play no part in score() and stay as they are in drop_toxic(), whatever their names. Repeated labels of one id count once, toxic if any is. Repeated
rows are scored as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Labelled rows that the fit takes at most (in expectation; the rows of the lowest id hashes).
SAMPLE = 20_000
#: Features of the model at most; and labelled rows to a feature at least, lest few labels be spread over many features.
FEATURES = 1_500
ROWS_PER_FEATURE, LEAST_FEATURES = 8, 30
MIN_TEXTS = 4
RIDGE = 0.1
PREFIXES = (4, 5, 6, 7)
#: Learned terms at most, the most frequent ones; texts of each class that a term must stand in; how many standard errors
#: its rates may lie apart; terms of a learned kind at most.
TERMS, TERM_TEXTS, TERM_ERRORS, KIND_SIZE = 96, 8, 1.5, 6
#: Words that a worker remembers the features of; without influence on results.
MEMORY = 100_000

# Words that name a group, by kind; swaps stay within a kind.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("man", "woman"),
    ("men", "women"),
    ("male", "female"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("deaf", "blind", "disabled"),
    ("musulman", "chrétien", "juif", "bouddhiste", "athée"),
    ("musulmán", "cristiano", "judío", "budista", "ateo"),
    ("muslimisch", "christlich", "jüdisch", "buddhistisch", "atheistisch"),
)

_word = re.compile(r"[^\W\d_]+")
_sentence = re.compile(r"(?<=[.!?])\s+|\n+")


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def text_features(text: str) -> set[str]:
    return {f for w in set(_word.findall(text.lower())) for f in word_features(w)}


Kinds = dict[str, tuple[str, ...]]


def kinds_of(groups: Iterable[tuple[str, ...]]) -> Kinds:
    """Each term with the other terms of its kind; a term in several kinds belongs to the first."""
    out: Kinds = {}
    for terms in groups:
        own = [w for w in dict.fromkeys(terms) if w not in out]
        out |= {w: tuple(x for x in own if x != w) for w in own}
    return out


def twins(sentence: str, kinds: Kinds) -> list[tuple[set[str], set[str]]]:
    """Of each twin the features it has more and less than the sentence. A twin has one term replaced, wherever it stands."""
    words = set(_word.findall(sentence.lower()))
    terms = sorted(words & kinds.keys())
    if not terms:
        return []
    held = Counter(f for w in words for f in word_features(w))
    out = []
    for term in terms:
        own = word_features(term)
        for other in kinds[term]:
            new = word_features(other)
            out.append(({f for f in new if f not in held or (held[f] == 1 and f in own)} - set(own), {f for f in own if held[f] == 1} - set(new)))
    return out


@dataclass
class Model:
    index: dict[str, int]
    weight: np.ndarray
    intercept: float
    #: The identity terms by kind, and how many twins of labelled sentences change features.
    kinds: Kinds = field(default_factory=dict)
    n_twins: int = 0

    def scores(self, texts: list[str], memory: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
        memory = {} if memory is None else memory
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found: set[int] = set()
            for w in set(_word.findall(text.lower())):
                has = memory.get(w)
                if has is None:
                    if len(memory) > MEMORY:
                        memory.clear()
                    has = memory[w] = tuple(self.index[f] for f in word_features(w) if f in self.index)
                found.update(has)
            out[i] = self.intercept + self.weight[list(found)].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_weights(rows: list[list[int]], y: np.ndarray, changes: list[tuple[list[int], list[int], int]], n: int, fairness: float, ridge: float = 0.01, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method. rows: the features of each text; changes: those that a swap adds and takes
    away, and how often. The penalty is fairness times the mean of the squared logit changes; ridge is per text, on the
    weights only."""
    m = len(y)

    def dense(part: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(part), n + 1), np.float32)
        for i, r in enumerate(part):
            x[i, r] = 1
        x[:, n] = 1
        return x

    parts = [(dense(rows[i : i + 2000]), y[i : i + 2000]) for i in range(0, m, 2000)]  # SAMPLE x FEATURES bounds them
    penalty = np.diag(np.r_[np.full(n, ridge / m), 1e-9])
    total = sum(k for *_, k in changes)
    for a, b, k in changes:
        at, sign = np.r_[a, b].astype(np.int64), np.r_[np.ones(len(a)), -np.ones(len(b))]
        penalty[np.ix_(at, at)] += 2 * fairness * k / total * np.outer(sign, sign)

    def loss(w: np.ndarray) -> float:
        return sum(float((np.logaddexp(0, z := r @ w) - t * z).sum()) for r, t in parts) / m + w @ penalty @ w / 2

    w = np.zeros(n + 1)
    w[n] = np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))
    now = loss(w)
    for _ in range(steps):
        gradient, curvature = penalty @ w, penalty.copy()
        for x, t in parts:
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            gradient += x.T @ (p - t) / m
            curvature += (x.T * np.float32(1 / m) * (p * (1 - p)).astype(np.float32)) @ x
        step = np.linalg.solve(curvature + 1e-9 * np.eye(n + 1), gradient)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        done = now - new < 1e-10
        if new < now:
            w, now = w - size * step, new
        if done:
            break
    return w[:n], float(w[n])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, fairness: float = 1.0, ridge: float = RIDGE) -> Model:
    """A model learned from the labelled rows that aren't held out."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~is_held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    if not n:
        return Model({}, np.zeros(0), 0.0)
    million = 1_000_000
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(million)) < int(min(1.0, sample / n) * million) + 1)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    # `sample` bounds the rows that are broadcast: two numbers each
    train = cut(texts.join(F.broadcast(chosen), "id").select("y", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y > 0].update(text_features(text))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], names=["f", "bad", "good"])

    totals = train.agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") <= 0).alias("good")).first()
    n_bad, n_good = totals["bad"], totals["good"]
    if not n_bad or not n_good:
        return Model({}, np.zeros(0), 0.0)
    tally = train.mapInArrow(count, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # signed root of the likelihood ratio, roughly: how far a feature's rate among toxic texts is from that among others
    share_bad, share_good = (F.col("bad") + 0.5) / (n_bad + 1), (F.col("good") + 0.5) / (n_good + 1)
    weight = F.abs(F.log(share_bad / share_good)) * F.sqrt(F.col("bad") / (n_bad + 1) + F.col("good") / (n_good + 1))
    best = tally.where(F.col("bad") + F.col("good") >= MIN_TEXTS).orderBy(F.desc(weight), "f").limit(min(FEATURES, max(LEAST_FEATURES, (n_bad + n_good) // ROWS_PER_FEATURE))).collect()
    kinds = kinds_of([*IDENTITY, *learned_kinds(train, tally, n_bad, n_good)])
    index = {f: i for i, f in enumerate(dict.fromkeys([*(r["f"] for r in best), *kinds]))}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = [int(y > 0) for y in batch.column(0).to_pylist()]
            has = [sorted(index[f] for f in text_features(text) if f in index) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(has, pa.list_(pa.int32()))], names=["y", "has"])

    def swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for sentence in dict.fromkeys(_sentence.split(text)):
                    for more, less in twins(sentence, kinds):
                        seen[tuple(sorted(index[f] for f in more if f in index)), tuple(sorted(index[f] for f in less if f in index))] += 1
            plus, minus, times = [list(a) for a, _ in seen], [list(b) for _, b in seen], list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(plus, pa.list_(pa.int32())), pa.array(minus, pa.list_(pa.int32())), pa.array(times, pa.int64())], names=["plus", "minus", "n"])

    rows = train.mapInArrow(vectors, "y int, has array<int>").collect()  # at most about `sample`
    rows.sort(key=lambda r: (r["has"], r["y"]))
    # equal changes are one row; their number is bounded by the terms and their kinds, not by the texts
    changed = train.select("text").mapInArrow(swaps, "plus array<int>, minus array<int>, n long").groupBy("plus", "minus").agg(F.sum("n").alias("n")).collect()
    changes = sorted((r["plus"], r["minus"], r["n"]) for r in changed if r["plus"] or r["minus"])
    w, b = fit_weights([r["has"] for r in rows], np.array([r["y"] for r in rows], float), changes, len(index), fairness, ridge)
    return Model({f: i for f, i in index.items() if w[i] != 0}, w, b, kinds, sum(k for *_, k in changes))


def learned_kinds(train: DataFrame, tally: DataFrame, n_bad: int, n_good: int) -> list[tuple[str, ...]]:
    """Neutral, interchangeable words of train(y, text), by kind. tally has their texts by class."""
    apart = F.abs(F.log((F.col("bad") / n_bad) / (F.col("good") / n_good))) / F.sqrt(1 / F.col("bad") + 1 / F.col("good"))
    words = tally.where(~F.col("f").endswith("*") & (F.length("f") > 3)).where((F.col("bad") >= TERM_TEXTS) & (F.col("good") >= TERM_TEXTS))
    neutral = [r["f"] for r in words.where(apart <= TERM_ERRORS).orderBy(F.desc(F.col("bad") + F.col("good")), "f").limit(TERMS).collect()]
    if not neutral:
        return []
    known = set(neutral)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = _word.findall(text.lower())
                seen.update((b, a) for a, b in zip(found, found[1:]) if b in known)  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "left", "n"])

    pairs = train.select("text").mapInArrow(before, "w string, left string, n long").groupBy("w", "left").agg(F.sum("n").alias("n"))
    most = pairs.groupBy("w").agg(F.max_by("left", F.struct("n", "left")).alias("left")).collect()  # a row a term
    place = {w: i for i, w in enumerate(neutral)}
    groups: dict[str, list[str]] = {}
    for r in sorted(most, key=lambda r: place[r["w"]]):
        groups.setdefault(r["left"], []).append(r["w"])
    return [tuple(g[i : i + KIND_SIZE]) for _, g in sorted(groups.items()) for i in range(0, len(g), KIND_SIZE) if len(g[i : i + KIND_SIZE]) > 1]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist(), memory))], names=["id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows that the model rejects, all columns as they were, in place and without a shuffle."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}
        at = names.index(text_col)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(model.scores(texts, memory) < threshold))

    return docs.mapInArrow(run, schema)
