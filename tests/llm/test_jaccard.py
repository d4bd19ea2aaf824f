import random
import re
from collections import defaultdict

import pytest
from assay.llm import jaccard, queries
from assay.llm.jaccard import jaccard_components


def shingles(text, k=4):
    words = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {" ".join(words)} if words else set()


def brute(rows, percent=85):
    """Every pair that shares a shingle, by an index of all of them."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at, same = defaultdict(list), {}
    for i, s in enumerate(sets):
        key = frozenset(s)
        if s and key in same:
            root[find(i)] = find(same[key])
            continue
        same[key] = i
        both = defaultdict(int)
        for g in s:
            for j in at[g]:
                both[j] += 1
            at[g].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    least = lambda x: min((v for v in x if v is not None), default=None)
    return sorted(((doc, len(s), least(ids[find(i)])) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def run(spark, rows, **kw):
    return sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **kw).collect()), key=repr)


def test_whole_table_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_ngram_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute(rows)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Near copies at about the bound, chains of copies of copies, a passage that all share, and unrelated rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(500)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(60):
        texts.append(passage + [word() for _ in range(rng.randrange(1, 80))])
    base = [word() for _ in range(150)]
    texts += [edited(rng, base, rng.randrange(0, 4)) for _ in range(150)]
    chain = [word() for _ in range(120)]
    for _ in range(40):
        chain = edited(rng, chain, rng.randrange(1, 5))
        texts.append(chain)
    texts += [[word() for _ in range(rng.randrange(0, 12))] for _ in range(60)]
    texts += texts[::7]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,small,long,often,grams", [(1, 16, 2048, 64, 10**6), (2, 2, 8, 4, 1000), (3, 3, 5, 10**9, 3000)])
def test_corpora_at_the_bound(spark, monkeypatch, seed, small, long, often, grams):
    """Also with tiny blocks, so that columns are passed on, dealt out and compared across blocks."""
    for name, value in (("SMALL", small), ("LONG", long), ("OFTEN", often), ("GRAMS", grams), ("MEMBERS", small * 20)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("percent", [50, 100])
def test_other_bounds(spark, percent):
    rows = corpus(4)[:200]
    assert run(spark, rows, percent=percent) == brute(rows, percent)


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(20_000))
    rows = [(5, None), (6, ""), (6, " \t\n"), (None, None), (1, "one"), (2, "ONE"), (3, "one two three"), (4, "One two\nthree"), (7, "a b c d"), (7, "a b c d e"), (None, "a b c d"), (8, long), (9, long + " x y"), (10, "É é"), (11, "é É"), (12, "x y z w " * 5000), (13, "y z w x " * 5000)]
    assert run(spark, rows) == brute(rows)
    nulls = [(None, "p q r s"), (None, "p q r s"), (None, "t")]
    assert run(spark, nulls) == brute(nulls)


def test_empty_and_clashing_names(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", "x", 1, 2), (2, "A B", "y", 3, 4)], "id2 long, body string, sig string, node int, component_id int")
    assert sorted(tuple(r) for r in jaccard_components(df, "id2", "body").collect()) == [(1, 1, 1), (2, 1, 1)]


def test_sketches_differ_in_no_more_cells_than_sets_in_elements():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, m in ((5, 6), (900, 1100), (1500, 1200), (5000, 4400), (3000, 40_000)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.r_[x[: len(x) // 2], rng.integers(0, 1 << 63, m).astype(np.uint64)])
        apart = len(np.setxor1d(x, y))
        cells = jaccard._differ([jaccard._sketch(x), jaccard._sketch(y)], [jaccard._sketch(y), jaccard._sketch(x)])
        assert cells[0] == cells[1] <= apart
        if max(n, m) < 10_000:
            assert cells[0] > 0.2 * apart
