import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from assay.llm import queries
from assay.llm.centroids import Centroids, cluster

DIM = 64


def brute(rows, k=8, rounds=10, dim=DIM, scale=1024, seed=3):
    """The contract in Python's integers."""
    kept = [(i, [math.floor(Fraction(v) * scale) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), n) for n, (i, _) in enumerate(kept) if i is not None)[:k]
    cents = [kept[n][1] for _, n in first]
    if not cents:
        return []
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, q in kept:
            groups[near(q)[1]].append(q)
        cents = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, cents, strict=True)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    of = [sum(d for _, c, d in out if c == j) for j in range(len(cents))]
    long = lambda v: v if v < 2**63 else None
    return sorted(((i, c, long(d), long(of[c]), long(sum(of)), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((tuple(r) for r in cluster(df, **kw).collect()), key=repr)


def test_whole_table_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_centroid_clustering(spark, sf).collect()), key=repr)
    assert got == brute(rows)


def test_dropped_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=DIM)]) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [float("nan")]), (105, [float("inf")] * DIM), (106, [0.0] * DIM), (107, [-0.0] * DIM)]
    assert run(spark, rows) == brute(rows)


def test_values_beyond_the_exact_range(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=DIM) * s]) for i, s in enumerate([1.0] * 12 + [1e3] * 4 + [1e6] * 4 + [1e13] * 3 + [1e200, 1.7e308])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[2] is None for r in got) and any(r[2] is not None for r in got)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    rows = [(i, [float(i)] * DIM) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * DIM) for i in range(20)]  # all centroids are copies of two points
    assert run(spark, rows) == brute(rows)


def test_clashing_names(spark):
    rows = [(i, [float(i), 1.0], "x", 7) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, v array<float>, cluster string, distance int")
    assert sorted((tuple(r) for r in cluster(df, "id", "v", dim=2).collect()), key=repr) == brute([(r[0], r[1]) for r in rows], dim=2)


def test_bound_of_the_matrix_product():
    top = math.isqrt((2**53 - 1) // DIM)
    at = Centroids([[0] * DIM, [top // 2] * DIM], 1)
    for v in (top - top // 2, top - top // 2 + 1):
        _, far, quick, _ = at.nearest(np.full((1, DIM), float(-v)))
        assert far[0] == DIM * v * v and len(quick) == (v == top - top // 2)
