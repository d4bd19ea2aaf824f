import random
import re
import zlib
from collections import Counter

import pytest
from assay.llm import queries
from assay.llm.spellings import counted_words, near_pairs, spelling_variants, variants


def brute_words(rows, least=7, typo=31):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typo and h % typo == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                c[w] += 1
    return c


def brute_near(words):
    """By deletions: every pair one edit apart shares a text that lacks one character."""
    less = {}
    for w in words:
        for i in range(len(w)):
            less.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), group in less.items():
        for w in group:
            near[w] |= group - {w}
            if a + b in near:
                near[w].add(a + b)
                near[a + b].add(w)
    return near


def brute(counts, factor=10):
    near, out = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best is not None and counts[best] >= factor * n else None, n, len(near[w])]
    rows = set()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, None if form is None else counts[form]))
    return rows


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_whole_table_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = {w: n for w, n in brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]).items() if n >= 2}
    got = [tuple(r) for r in queries.op12_spelling_variants(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) == len(counts) and set(got) == brute(counts)


@pytest.mark.parametrize("seed,letters,most", [(1, "ab", 6), (2, "abc", 7), (3, "aeéÿ", 5), (4, "z", 30)])
def test_random_words(spark, seed, letters, most):
    """Dense tries, so that all kinds of edits, repeated letters and nodes over several partitions occur."""
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(1, most))) for _ in range(400)}
    counts = {w: 10 ** rng.randint(0, 4) for w in words}
    df = frame(spark, counts)
    pairs = [tuple(sorted((r.a, r.b))) for r in near_pairs(df).collect()]
    want = {tuple(sorted((a, b))) for a, near in brute_near(counts).items() for b in near}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert {tuple(r) for r in variants(df).collect()} == brute(counts)


def test_edges_and_ties(spark):
    counts = {"aaaa": 1, "aaab": 10, "aaac": 10, "aaa": 100, "aaaab": 1000, "x" * 5000: 3, "x" * 5001: 40, "y": 9}
    got = {tuple(r) for r in variants(frame(spark, counts)).collect()}
    assert got == brute(counts)
    assert {r[0]: r[2] for r in got}["aaaa"] == "aaaab"


def test_words_of_odd_rows(spark):
    rows = [(1, "Straßenbahn STRASSENBAHN Éléphants short ××××××× a1b"), (1, "strassenbahn"), (None, "strassenbahn"), (2, None), (3, ""), (4, "x" * 100_000), (5, "strassenbahn " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for typo in (0, 31, 1):
        assert {r.word: r.n for r in counted_words(df, typo=typo).collect()} == brute_words(rows, typo=typo)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(empty).count() == 0
    df = spark.createDataFrame([(1, "abcdefgh abcdefgh", "w", 3)], "id long, body string, word string, n int")
    assert [tuple(r) for r in spelling_variants(df, "id", "body").collect()] == [("abcdefgh", None, "abcdefgh", 2, 0, None)]
