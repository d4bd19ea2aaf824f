"""Extra columns with the names that operators use themselves, and empty tables, where no other test has them."""

from assay.llm import fingerprint, packing, suffix_dedup, toxicity
from pyspark.sql import functions as F

ROWS = [(1, "one two three four five", "x"), (2, None, None), (3, "six", "y")]


def clashing(spark, *names):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, z string")
    for n in names:
        df = df.withColumn(n, F.col("z"))
    return df.drop("z"), spark.createDataFrame(ROWS, "doc_id long, text string, z string").drop("z")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_packing(spark):
    odd, plain = clashing(spark, "start", "length", "sequence_id", "offset", "size", "id")
    assert same(packing.pack(odd), packing.pack(plain))


def test_suffix_dedup(spark):
    odd, plain = clashing(spark, "n_bytes", "id", "key", "spans", "row", "h")
    assert same(suffix_dedup.repeat_report(odd), suffix_dedup.repeat_report(plain))
    assert same(suffix_dedup.remove_repeats(odd), suffix_dedup.remove_repeats(plain))


def test_fingerprints(spark):
    odd, plain = clashing(spark, "d", "cells", "__d", "id", "bucket", "set_", "e", "p")
    assert same(fingerprint.edited_likeness(odd), fingerprint.edited_likeness(plain))
    got = fingerprint.fingerprints(odd)
    assert got.columns == [*odd.columns, "fingerprint"]
    assert same(got.select("doc_id", "fingerprint"), fingerprint.fingerprints(plain).select("doc_id", "fingerprint"))


def test_toxicity(spark):
    rows = [(i, ("awful idiots go away " if i % 2 else "a calm walk in the park ") + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(60)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    odd = docs.withColumns({n: F.lit("q") for n in ("score", "predicted", "held_out", "words", "x")})
    assert same(toxicity.score(odd, model), toxicity.score(docs, model))
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.drop_toxic(docs.limit(0), model).count() == 0
    for none in (toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels.limit(0))):
        assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
