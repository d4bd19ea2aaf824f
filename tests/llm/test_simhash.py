import random

import pytest
import xxhash
from pyspark.sql import functions as F

from assay.llm.simhash import connected_components, drop_near_copies, links, near_duplicates


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{doc_id: fp} -> {doc_id: smallest id reachable}"""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 14))) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "One", "two three", "ä ö ü é", "A\x0bB\x0cC\x1cD e", "x " * 3000]
    for _ in range(40):
        base = words(rng, rng.choice([3, 4, 5, 30, 200]))
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            w = base.split()
            w[rng.randrange(len(w))] = words(rng, 1)
            texts.append(rng.choice([" ".join(w), base, base.upper(), base.replace(" ", "\n  ")]))
    docs = spark.createDataFrame([(i * 7 + 3, t, "fp", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, key int")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(docs).collect()}
    want = {i * 7 + 3: brute_fp(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in got.items()} == want
    assert {i: c for i, (_, c) in got.items()} == brute_components(want)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_components(want).values())


@pytest.mark.parametrize("long", [3, 10_000])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, long):
    monkeypatch.setattr("assay.llm.simhash.LONG", long)
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for c in centres for _ in range(60)} | {0, (1 << 64) - 1})
    signed = {(f ^ (1 << 63)) - (1 << 63) for f in (x & (1 << 64) - 1 for x in fps)}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in connected_components(links(df)).collect()}
    want = brute_components({f: f & (1 << 64) - 1 for f in signed})
    assert {f: found.get(f, f) for f in signed} == want


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "other words stand here now")]
    got = near_duplicates(spark.createDataFrame(rows, schema))
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, 4), (2, 2), (4, 4), (4, 4)]


def test_chain_of_components(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(edges).collect()} == {0}


def test_any_four_positions_hold_a_triple():
    from itertools import combinations

    from assay.llm.simhash import TRIPLES

    assert len(TRIPLES) == 20 and all(any(set(t) <= set(four) for t in TRIPLES) for four in combinations(range(8), 4))


def test_one_row_of_each_component_stays_with_repeated_and_null_ids(spark):
    a, b, c = "a b c d e f", "other words stand here now", "nothing like it at all stands in the third"
    rows = [(4, a, 1), (4, a, 2), (2, b, 3), (4, b, 4), (None, c, 5), (None, a, 6), (None, c, 7)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, c), (2, b), (4, a)]
    assert drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    empty = drop_near_copies(spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " ", "z")], "doc_id long, text string, row string")).collect()
    assert [tuple(r) for r in empty] == [(1, None, "x")]


def test_components_in_one_and_in_many_blocks(spark, monkeypatch):
    import random

    from assay.llm import simhash

    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)] + [(7, 7)] + [(10_000, i) for i in range(1100, 1400)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(i, find(i)) for a, b in edges if a != b for i in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for block in (10**6, 50):
        monkeypatch.setattr(simhash, "EDGES", block)
        got = [tuple(r) for r in simhash.connected_components(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want
