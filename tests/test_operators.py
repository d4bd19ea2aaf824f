import math

from assay.functions import names
from assay.operators import copies, graph, relate, scoring, statistics, text
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_three_rules_of_test_paths(spark):
    paths = ["tests/a.py", "unittest/a.py", "unit_tests/a.py", "src/test", "test_data/a.py", "test_a.txt", "my_conftest.py", "tests.py", "latest/a.py", None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    got = df.orderBy("i").select(*[names.is_test_path(F.col("path"), r) for r in ("gate", "footprint", "review")]).collect()
    want = ["111", "100", "010", "001", "001", "011", "001", "110", "000", None, "000"]
    assert [None if r[0] is None else "".join(str(int(x)) for x in r) for r in got] == want


def test_set_scores(spark):
    make = lambda items: spark.createDataFrame([("r", x) for x in items], "id string, dep string")
    got = scoring.micro(scoring.set_scores(make("abc"), make("bcd"), "id", "dep")).first()
    assert tuple(got)[:3] == (2, 1, 1) and all(math.isclose(x, 2 / 3) for x in tuple(got)[3:])
    assert tuple(scoring.micro(scoring.set_scores(make(""), make(""), "id", "dep")).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_names(spark):
    df = spark.createDataFrame([("Foo-Bar.baz", "pkg[x]>=1 ; m"), ("r1__hide__dep_a", "# c"), (None, "-r o.txt"), ("a", "n @ http://h/w.whl"), ("b", "")], "a string, line string")
    got = df.select(names.norm(F.col("a")), names.metric_name(F.col("a")), names.requirement_name(F.col("line"))).collect()
    assert tuple(got[0]) == ("foo_bar_baz", "foo_bar.baz", "pkg") and [r[2] for r in got] == ["pkg", None, None, "n", None]
    part = df.where("a like 'r1%'").select(*[names.id_part(F.col("a"), i) for i in (1, 2, -1)]).first()
    assert tuple(part) == ("r1", "hide", "dep_a")
    one = spark.range(1).select(names.words(F.lit("Iechä üb")), names.lines(F.lit("a\r\nb\n")), names.shift_site(F.lit("x/y.py:9"), 3), names.base36(F.lit(71)), names.suite_verdict(F.lit("3 passed, 1 failed")), names.strip_ansi(F.lit("\x1b[31mred\x1b[0m"))).first()
    assert tuple(one) == (["Iechä", "üb"], ["a", "b"], "x/y.py:12", "1z", "fail", "red")


def test_gaps_regions_and_carry(spark):
    df = spark.createDataFrame([("k", i) for i in (0, 1, 4, 7, 8)], "k string, i int")
    assert rows(relate.gaps(df, "k", "i")) == [("k", 2, 4), ("k", 5, 7)]
    marked = spark.createDataFrame([("k", i, x) for i, x in enumerate(["keep", "BEGIN", "x", "END", "keep"])], "k string, i int, line string")
    assert [r[1] for r in rows(relate.drop_regions(marked, "k", "i", F.col("line") == "BEGIN", F.col("line") == "END"))] == [0, 4]


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 3)], "k string, v int")
    assert rows(relate.last_wins([a, b], ["k"], "v")) == [("x", 3), ("y", 2)]
    points = spark.createDataFrame([("f", 5), ("f", 40), ("g", 5)], "k string, p int")
    spans = spark.createDataFrame([("f", 3, 39)], "k string, low int, high int")
    assert rows(relate.interval_join(points, spans, "k", "p", "low", "high", 7).select("k", "p")) == [("f", 5)]
    events = spark.createDataFrame([("f", 1), ("f", 5)], "k string, at int")
    states = spark.createDataFrame([("f", 2, "s"), ("f", 5, "t")], "k string, at int, state string")
    assert rows(relate.as_of(events, states, "k", "at", "state")) == [("f", 1, None), ("f", 5, "t")]


def test_statistics(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 6)], "v int")
    assert v.agg(statistics.quantile_index(F.col("v"), 0.9)).first()[0] == 4
    assert v.where("v < 5").agg(statistics.upper_median(F.col("v"))).first()[0] == 3
    flat = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "x double, y double")
    assert flat.agg(statistics.pearson("x", "y")).first()[0] is None
    h = statistics.buckets(spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.1001, 0.5, 0.51)], "x double"), "x", [("0", 0.0), ("1-10", 0.1), ("10-25", 0.25), ("25-50", 0.5)])
    assert {r.bucket: r.n for r in h.collect()} == {"0": 1, "1-10": 1, "10-25": 1, "25-50": 1, ">": 1}
    groups = spark.createDataFrame([("r1", 3, 4), ("r2", 2, 4), ("r3", 0, 5), ("r4", 1, 3), ("r5", 1, 2)], "g string, s int, n int")
    got = {r.k: (round(r.median_rate, 4), r.affected, r.groups) for r in statistics.leave_top_out(groups, "g", "s", "n", [1, 3], 3).collect()}
    assert got == {1: (0.3333, 2, 3), 3: (0.0, 0, 1)}
    strata = spark.createDataFrame([("a", 50), ("b", 30), ("c", 15), ("d", 5)], "s string, n int")
    assert [r[2] for r in rows(statistics.largest_remainder(strata, "s", "n", 7))] == [4, 2, 1, 0]


def test_gates(spark):
    g = spark.createDataFrame([("pass", "pass", "pass"), ("fail", "pass", "pass"), ("pass", "pass", "unverified"), ("pass", "pass", None)], "G1 string, G2 string, G3 string")
    got = [tuple(r)[2:] for r in statistics.ablation(g, ["G2", "G1", "G3"]).orderBy("step").collect()]
    assert got == [(4, 0, 0), (3, 1, 0), (2, 0, 1)]
    v = [r[0] for r in g.select(statistics.verdict([F.col(c) for c in ("G1", "G2", "G3")])).collect()]
    assert v == ["accepted", "rejected", "withheld", "accepted"]
    k = spark.createDataFrame([(True, False, None), (False, False, False), (False, None, None), (True, None, True)], "structural boolean, tests boolean, library boolean")
    assert {r.caught_by for r in statistics.overlap(k, ["structural", "tests", "library"]).collect()} == {"structural", "none (all 3 spoke)", "none (1 of 3 could speak)", "structural+library"}


def test_copies(spark):
    tokens = spark.createDataFrame([("d", i, str(x)) for i, x in enumerate([5, 3, 9, 1, 7, 1])], "id string, at int, token string")
    got = copies.winnow(tokens, "id", 1, 3, lambda c: c.cast("int"))
    assert sorted(r.print for r in got.collect()) == [1, 3]
    few = copies.winnow(tokens.where("at < 3"), "id", 1, 3, lambda c: c.cast("int"))
    assert sorted(r.print for r in few.collect()) == [3, 5, 9]
    gate = spark.range(1).select(copies.copy_gate(F.lit(59), F.lit(1.0)), copies.copy_gate(F.lit(60), F.lit(0.6)), copies.copy_gate(F.lit(60), F.lit(None).cast("double"))).first()
    assert tuple(gate) == (True, False, None)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in graph.reach(edges, seed, 3).collect()} == set("abcd")
    assert {r.node: r.depth for r in graph.reach(edges, seed).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}


def test_diffs(spark):
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n keep\n+one\n-two\ndiff --git a/y.py b/y.py\n--- a/y.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
    df = spark.createDataFrame([(1, patch)], "id int, patch string")
    assert rows(text.diff_summary(df, "id", "patch")) == [(1, "x.py", 1, 1), (1, "y.py", 0, 1)]
