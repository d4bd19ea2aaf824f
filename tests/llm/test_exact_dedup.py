import hashlib

from assay.llm import exact_dedup
from assay.llm.exact_dedup import drop_copies, exact_groups
from pyspark.sql import functions as F

ROWS = [(5, "a", "x"), (2, "a", "y"), (9, None, "x"), (1, "", "z"), (7, "b", None), (7, "b", None), (None, "c", "q"), (3, "Ä" * 50_000, "l"), (4, "Ä" * 50_000, "l")]
SCHEMA = "doc_id long, text string, hash string"


def test_groups(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for keep, pick in (("max", max), ("min", min)):
        got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, keep=keep).collect())
        want = []
        for i, t, _ in ROWS:
            same = [j for j, u, _ in ROWS if (u or "") == (t or "")]
            ids = [j for j in same if j is not None]
            k = pick(ids) if ids else None
            want.append((i or 0, k, len(same), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want)


def test_drop_copies_keeps_whole_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = drop_copies(docs, keep="max")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.hash) for r in got.collect()) == [(0, "q"), (4, "l"), (5, "x"), (7, None), (9, "x")]
    assert sorted(r.doc_id or 0 for r in drop_copies(docs, keep="min").collect()) == [0, 1, 2, 3, 7]


def test_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda c: F.lit("same"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert {(r.keep_id, r.group_size) for r in exact_groups(docs, keep="max").collect()} == {(5, 2), (9, 2), (7, 2), (None, 1), (4, 2)}


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_copies(spark.createDataFrame([], SCHEMA)).count() == 0
