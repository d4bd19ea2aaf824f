"""Steps that must not grow faster than their input: same results as brute force, and bounds on what is moved."""

import random
import re
import time

from assay.functions import names
from assay.operators import census, copies, gates, graph, modules, relate, text, traces
from pyspark.sql import functions as F


def shuffled(spark):
    """Bytes of shuffle files."""
    found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).length() for i in range(found.size()))


def within(seconds, condition):
    """Spark deletes in the background."""
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    return condition()


def test_best_match_of_token_arrays_with_many_copies(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(40)]
    left = [(i, rng.choices(pool, k=rng.randint(0, 12))) for i in range(60)] + [(100 + i, ["x", "y", "z", None]) for i in range(200)]
    right = [(1000 + i, rng.choices(pool, k=rng.randint(0, 12))) for i in range(60)] + [(2000 + i, ["z", "y", "x", "x"]) for i in range(200)] + [(5, [])]
    left, right = left + [(i + 500, ws) for i, ws in left[:10]], right + [(i + 500, ws) for i, ws in right[:10]] + [(8000, left[3][1])]
    want = {}
    for a, x in left:
        x = {w for w in x if w is not None}
        for b, y in right:
            y = set(y)
            j = len(x & y) / len(x | y) if x | y else 0
            if j >= 0.3 and len(x) >= 2 and (a not in want or (-j, b) < want[a][:2]):
                want[a] = (-j, b, len(x & y))
    got = relate.best_match(spark.createDataFrame(left, "a int, w array<string>"), spark.createDataFrame(right, "b int, w array<string>"), "a", "b", "w", 0.3, least_left=2)
    assert {r.a: (-r.jaccard, r.b, r.shared) for r in got.collect()} == want


def test_best_match_goes_in_passes_that_leave_no_shuffle_files(spark, monkeypatch):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(40)]
    sets = lambda n, first: [(first + i, rng.choices(pool, k=rng.randint(1, 14)) + [f"x{rng.randrange(900)}"]) for i in range(n)]
    left, right = sets(300, 0), sets(300, 1000)
    left += [(i, ["w1", "only"]) for i in (3, 5)] + [(500, right[0][1])]
    right += [(1003, ["w2"])]
    joined = lambda rows: {k: set().union(*(ws for j, ws in rows if j == k)) for k, _ in rows}
    want = {a: min(((-len(x & y) / len(x | y), b) for b, y in joined(right).items() if len(x & y) >= 0.4 * len(x | y)), default=None) for a, x in joined(left).items()}
    dfs = spark.createDataFrame(left, "a int, w array<string>"), spark.createDataFrame(right, "b int, w array<string>")
    monkeypatch.setattr(relate, "STARTS", 500)
    for vocabulary, known in ((1_000_000, 1 << 20), (10, 4), (0, 4)):
        monkeypatch.setattr(relate, "VOCABULARY", vocabulary)
        monkeypatch.setattr(relate, "KNOWN", known)
        before = shuffled(spark)
        got = relate.best_match(*dfs, "a", "b", "w", 0.4)
        assert within(10, lambda: shuffled(spark) < before + 20_000)
        if vocabulary > 1000:
            assert got._jdf.queryExecution().optimizedPlan().toString().split("Union", 2)[-1].count("LogicalRDD") > 3
        assert {r.a: (-r.jaccard, r.b) for r in got.collect()} == {a: x for a, x in want.items() if x}


def test_phantoms_follow_a_dependency_once(spark, monkeypatch):
    kept = []
    cut = graph.cut

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    declared = [(s, d) for s in range(60) for d in range(10)]
    requires = [(d, 10 + d) for d in range(10)] + [(10 + d, 20 + d) for d in range(10)] + [(20 + d, (d + 1) % 10) for d in range(10)]
    got = graph.phantoms(spark.createDataFrame(declared, "src int, dst int"), spark.createDataFrame(requires, "src int, dst int"), 3)
    assert {tuple(r) for r in got.collect()} == {(s, d, (d - 1) % 10, 3) for s, d in declared}
    assert sum(kept) < 2 * len(declared)


def test_two_step_ways_meet_only_those_that_have_one(spark):
    rng = random.Random(3)
    edges = {(rng.randint(1, 40), rng.randint(1, 400)) for _ in range(900)}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    ahead = {a: set(to).union(*(out.get(x, ()) for x in to)) for a, to in out.items()}
    got = graph.through_others(spark.createDataFrame(sorted(edges), "src int, dst int"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a, b in edges if any(b in ahead.get(o, ()) for o in out[a] if o != b)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 3


def test_two_step_ways_go_in_passes_that_leave_no_shuffle_files(spark, monkeypatch):
    rng = random.Random(4)
    edges = sorted({(rng.randint(1, 60), rng.randint(1, 90)) for _ in range(2000)}) + [(1, 7), (1, None), (None, 7), (70, 71), (71, 71)]
    out = {}
    for a, b in edges:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)
    ahead = {a: set(to).union(*(out.get(x, ()) for x in to)) for a, to in out.items()}
    want = sorted((a, b) for a, to in out.items() for b in to if any(b in ahead.get(o, ()) for o in to if o != b))
    df = spark.createDataFrame(edges, "src int, dst int")
    for few, most in ((1_000_000, 1), (5, 1), (5, 10**9)):
        monkeypatch.setattr(graph, "FEW", few)
        monkeypatch.setattr(graph, "PAIRS", most)
        before = shuffled(spark)
        got = graph.through_others(df)
        assert within(10, lambda: shuffled(spark) < before + 20_000)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan if most > 1 else "Join" not in plan and plan.count("LogicalRDD") > 3
        assert sorted(map(tuple, got.collect())) == want
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_prints_made_in_the_row_are_those_of_windows(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices(["if", "x", "(", "7", "'s'", "+"], k=n))) for i, n in enumerate([0, 3, 4, 7, 8, 9, 40, 90])] + [(20, None)]
    df = spark.createDataFrame(docs, "k int, text string")
    for digest in (F.crc32, F.md5):
        want = {tuple(r) for r in copies.winnow(copies.token_rows(df, "k", "text"), "k", 4, 3, digest).collect()}
        got = df.select("k", copies.row_prints(names.words(F.lower("text")), 4, 3, digest).alias("prints"))
        assert {(r.k, p) for r in got.collect() for p in r.prints or []} == want
    prints = df.select("k", copies.row_prints(names.words(F.lower("text")), 4, 3).alias("prints"))
    lib = prints.where("k IN (5, 6)")
    plain = lambda t: t.select("k", F.explode("prints").alias("print"))
    pairs = copies.row_containment(prints, lib.withColumnRenamed("k", "l"), "k", "l")
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in copies.containment(plain(prints), plain(lib).withColumnRenamed("k", "l"), "k", "l").collect()}
    assert "Window" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    share = {r.k: r.containment for r in copies.row_library_containment(prints, lib, "k").collect()}
    whole = {r.k: r.containment for r in copies.library_containment(plain(prints), plain(lib), "k").collect()}
    assert share == {k: whole.get(k, 0.0) for k, _ in docs}


def test_copied_files_are_parsed_once(spark, monkeypatch):
    kept, to_all = [], modules.to_all

    def counted(df, *more):
        out = to_all(df, *more)
        kept.append(out.count())
        return out

    monkeypatch.setattr(modules, "to_all", counted)
    rows = [(r, f"p/m{i}.py", "import os, dep.sub as d\nfrom . import m1; d.run(d.x); d.run(d.x)\n") for r in range(30) for i in (1, 2)] + [(r, "p/__init__.py", "") for r in range(30)]
    edges, packages, _ = modules.module_graph(spark.createDataFrame(rows, "repo int, path string, text string"))
    assert kept[0] == 7
    assert {tuple(r) for r in edges.collect()} == {(r, f"p/m{i}.py", d) for r in range(30) for i in (1, 2) for d in ("p/__init__.py", "p/m1.py") if d != f"p/m{i}.py"}
    assert {tuple(r) for r in packages.collect()} == {(r, f"p/m{i}.py", "dep", 1, 4) for r in range(30) for i in (1, 2)}


def test_only_files_that_were_met_are_cleaned(spark):
    files = spark.createDataFrame([(1, "see CC, by-x"), (2, "cc  by."), (3, None), (4, "acc by"), (5, "none")], "p int, t string")
    found = census.mention_join(spark.createDataFrame([("l", "cc by")], "k string, v string"), files, "k", "v", "p", "t")
    assert {tuple(r) for r in found.collect()} == {("l", 1), ("l", 2)}
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].split("\n", 1)[1]
    assert "[^a-z0-9_-]+" not in below


def test_each_imported_name_is_looked_up_once(spark, monkeypatch):
    kept, to_all = [], traces.to_all

    def counted(df):
        out = to_all(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(traces, "to_all", counted)
    imports = [(f"{i}.py", n) for i in range(50) for n in ("p.sub.x", "p.y", "os", "p")] + [("p/__init__.py", "p.y")]
    known = [("p/__init__.py", "p"), ("p/sub.py", "p.sub")]
    got = traces.module_edges(spark.createDataFrame(imports, "path string, imported string"), spark.createDataFrame(known, "path string, module string"), "path", "imported", "module")
    assert sorted(map(tuple, got.collect())) == sorted((f"{i}.py", p) for i in range(50) for p, _ in known)
    assert kept == [2, 3]


def test_lines_of_patches_meet_no_paths(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-a\n+b\r\n c\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n-a\n+b\n"
    df = spark.createDataFrame([(1, patch), (2, patch), (3, None), (4, "")], "id int, patch string")
    crlf = spark.createDataFrame([(1, "x.py"), (1, "x.py"), (1, None), (2, "y.py"), (9, "x.py")], "id int, path string")
    got = text.matched_line_ends(df, "id", "patch", crlf)
    want = {1: patch.rstrip("\n").replace("\r", "").replace("-a\n+b\n c", "-a\r\n+b\r\n c\r"), 2: patch.rstrip("\n").replace("\r", "").replace("-a\n+b", "-a\r\n+b\r").replace("-a\r\n+b\r\n c", "-a\n+b\n c")}
    assert {r.id: r.text for r in got.collect() if r.id < 3} == want
    joined = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joined and not any("path" in x or "new" in x for x in joined)


def test_closure_report_follows_a_name_once_in_tasks_of_bounded_rows(spark, monkeypatch):
    kept, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    monkeypatch.setattr(graph, "PER_TASK", 100)
    links = [(f"p{i}", f"p{i + 10}") for i in range(30)] + [("p0", "p1")]
    after = {f"p{i}": {f"p{j}" for j in range(i, i + 31, 10)} for i in range(10)}
    after["p0"] |= {"p1", "p11", "p21"}
    rows = [(k, side, f"p{i}") for k in range(60) for side in ("before", "after") for i in range(10) if side == "before" or (i + k) % 10]
    subs = spark.createDataFrame([(k, f"p{k % 10}", True, True, True) for k in range(60)], "k int, t string, edited boolean, applied boolean, gold boolean")
    got = gates.closure_report(subs, "k", "t", spark.createDataFrame(rows, "k int, side string, name string"), None, spark.createDataFrame(links, "src string, dst string"))
    want = {}
    for k in range(60):
        sides = {s: set().union(*(after[n] for key, side, n in rows if (key, side) == (k, s))) for s in ("before", "after")}
        want[k] = (sorted(sides["after"] - sides["before"]), sorted(sides["before"] - sides["after"] - {f"p{k % 10}"}), len(sides["before"]), len(sides["after"]))
    assert {r.k: (r.added, r.removed, r.n_before, r.n_after) for r in got.collect()} == want
    assert sum(kept) < 200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert any(int(n) > 30 for n in re.findall(r"RepartitionByExpression \[k#\d+\], (\d+)", plan))
