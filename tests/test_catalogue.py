import glob
import os

import duckdb
import pytest
from assay.plans import audits, programs, removals, trees  # noqa: F401
from assay.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _plain(got.collect(), got.columns) == _plain(want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark, duck):
    edges = set(duck.execute("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem").fetchall())
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    ahead = {a: set(to).union(*(out.get(x, ()) for x in to)) for a, to in out.items()}
    want = {(a, b) for a, b in edges if any(b in ahead.get(o, ()) for o in out[a] if o != b)}
    assert set(map(tuple, QUERIES["phantom_prediction"](spark, DATA).collect())) == want
    depth, front = {1: 0}, {1}
    while front:
        front = {y for x in front for y in out.get(x, ())} - depth.keys()
        depth |= dict.fromkeys(front, max(depth.values()) + 1)
    assert {r.node for r in QUERIES["reachable"](spark, DATA).collect()} == depth.keys()
    pairs = set(duck.execute("SELECT DISTINCT o_custkey, o_orderpriority FROM orders").fetchall())
    assert {(r.o_custkey, r.o_orderpriority) for r in QUERIES["last_result_wins"](spark, DATA).collect()} == pairs
