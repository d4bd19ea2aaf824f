from assay.operators import draws, gates, graph, reports, traces
from assay.plans.catalogue import QUERIES
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
CFG = "[metadata]\nname = p\n[tool:pytest]\naddopts = -q\n[options]\ninstall_requires =\n    lib-a\naddopts = -q\n"


def gate(spark, patch, dep="lib-a", text=CFG, path="setup.cfg", injected=None):
    head = "" if patch is None or patch.startswith(("diff", "---")) else f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n"
    df = spark.createDataFrame([(1, None if patch is None else head + patch, dep)], "id int, patch string, dep string")
    originals = None if text is None else spark.createDataFrame([(1, path, text)], "id int, path string, text string")
    return gates.oracle_gate(df, "id", "patch", "dep", originals, injected).first()


def test_sections_of_the_unchanged_file(spark):
    hunk = "@@ -{} +{} @@\n-addopts = -q\n+addopts = -x\n"
    assert gate(spark, hunk.format(4, 4)).status == "fail"  # the nearest equal line is in [tool:pytest]
    assert gate(spark, hunk.format(8, 8)).status == "pass"  # here it is in [options]
    assert gate(spark, hunk.format(6, 6)).status == "fail"  # as far from both: the upper one
    assert gate(spark, hunk.format(4, 4), text=None).status == "pass"  # no header is known
    assert gate(spark, "@@ -3,2 +3,3 @@\n [tool:pytest]\n addopts = -q\n+ignore = x\n", text=None).findings[0].detail == ["[tool:pytest]", "+ignore = x"]
    assert gate(spark, "@@ -4 +4,2 @@\n addopts = -q\n+[other]\n+x = 1\n").status == "pass"  # the section ends within the hunk
    assert gate(spark, "@@ -400 +400 @@\n-unknown\n+x\n").status == "pass"  # beyond the end: [options]


def test_whole_names_only(spark):
    tox = lambda line, dep: gate(spark, f"@@ -1,2 +1 @@\n [testenv]\n-{line}\n", dep, None, "tox.ini").status
    assert tox("commands = pytest --strict", "py") == "fail"
    assert tox("deps = Lib_A>=2", "lib.a") == tox("    lib-a[x]", "LIB_A") == "pass"
    assert tox("deps = lib-abc", "lib-a") == tox("deps = lib-a", None) == "fail"
    assert gate(spark, "--- a/tox.ini\n+++ b/tox.ini\n@@ -1 +1 @@\n-a\n+lib-a\n", text=None).status == "fail"  # added, not removed


def test_evidence_null_patches_and_injected_blocks(spark):
    none = gate(spark, None)
    assert (none.status, none.reason, none.findings) == ("unverified", "no patch", [])
    body = "@@ -1,2 +1,4 @@\n def test_a():\n+    # BEGIN\n+    pytest.skip('x')\n+    # END\n+    assert f()\n"
    assert gate(spark, body, path="tests/test_a.py", injected=("# BEGIN", "# END")).status == "pass"
    seen = gate(spark, body, path="tests/test_a.py")
    assert seen.signals == "skip added" and seen.findings[0].detail == ["+pytest.skip('x')"] and seen.modified == ["tests/test_a.py"]
    gone = gate(spark, "--- a/tests/test_z.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-def test_z(): assert 1\n")
    assert gone.signals == "test file deleted" and gone.findings[0].detail == ["1 lines removed"]
    new = gate(spark, "--- /dev/null\n+++ b/tests/test_n.py\n@@ -0,0 +1 @@\n+def test_n(): pass\n")
    assert (new.status, new.reason, new.added) == ("pass", "no test file modified; 1 added", ["tests/test_n.py"])
    lost = gate(spark, "@@ -1,2 +1 @@\n-    self.fail('x')\n-    np.testing.assert_equal(a, b)\n+    x\n", path="a_test.py")
    assert lost.findings[0].detail == ["2 removed, 0 added"]
    assert gate(spark, "@@ -1 +1 @@\n-@parametrize('a', [1])\n+x\n", path="a_test.py").signals == "parametrisation removed"


def test_declarations_without_a_target(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"], None), (2, ["a", "b"], ["a"], "B"), (3, None, ["a"], "b")], "k int, b array<string>, a array<string>, t string")
    assert {r.k: r.status for r in gates.declaration_gate(df, "k", "b", "a", "t").collect()} == {1: "unverified", 2: "pass", 3: "unverified"}


def plain_draw(pool, n, per_repo, per_dep, band):
    """The whole rule over the whole pool, one step after the other."""
    import statistics
    from collections import Counter

    strata = sorted({p[0] for p in pool})
    size = {s: sum(p[0] == s for p in pool) for s in strata}
    quota = {s: n * size[s] // len(pool) for s in strata} if pool else {}
    for s in sorted(strata, key=lambda s: (-(n * size[s] % len(pool)), s))[: n - sum(quota.values())]:
        quota[s] += 1
    repos, deps, out = Counter(), Counter(), []
    fits = lambda p: repos[p[1]] < per_repo and deps[p[2]] < per_dep

    def take(p, filled):
        repos[p[1]] += 1
        deps[p[2]] += 1
        out.append((*p, len(out) + 1, filled))

    for s in sorted(strata, key=lambda s: (size[s], s)):
        left = [p for p in pool if p[0] == s]
        share = Counter(band(p[3]) for p in left)
        got = Counter()
        for taken in range(quota[s]):
            fit = [p for p in left if fits(p)]
            if not fit:
                break
            pick = min(fit, key=lambda p: (repos[p[1]], deps[p[2]], got[band(p[3])] - share[band(p[3])] / size[s] * (taken + 1), p[1], p[2]))
            left.remove(pick)
            got[band(pick[3])] += 1
            take(pick, False)
    if len(out) < n and pool:
        drawn = {o[:4] for o in out}
        middle = statistics.median([p[3] for p in pool if p[3] is not None])
        before = (Counter(repos), Counter(deps))
        for p in sorted((p for p in pool if p not in drawn), key=lambda p: (before[0][p[1]], before[1][p[2]], float("inf") if p[3] is None else abs(p[3] - middle), p[1], p[2], p[0])):
            if len(out) < n and fits(p):
                take(p, True)
    return set(out)


def bands(f):
    return "" if f is None else "0" if f == 0 else "1-2" if f <= 2 else "3+"


def spark_bands(c):
    return F.when(c == 0, "0").when(c <= 2, "1-2").when(c > 2, "3+")


def draw(spark, pool, n, per_repo, per_dep):
    df = spark.createDataFrame(pool + pool[:3], "s string, r string, d string, f int")
    return {tuple(r) for r in draws.stratified_draw(df, "s", "r", "d", "f", n, per_repo, per_dep, spark_bands).collect()}


def test_draw_where_one_dependency_is_very_common(spark):
    pool = [("x", f"r{i:04d}", "a", i % 4) for i in range(1000)] + [("x", "zzz", "b", 1), ("y", "r0001", "c", None), ("y", "zzz", "d", 3)]
    for n, per_repo, per_dep in ((5, 1, 9), (12, 2, 3), (30, 9, 99)):
        got = draw(spark, pool, n, per_repo, per_dep)
        assert got == plain_draw(pool, n, per_repo, per_dep, bands)
    assert ("x", "zzz", "b") in {g[:3] for g in draw(spark, pool, 12, 2, 3)}


def test_random_draws_against_the_whole_rule(spark):
    import random

    for seed, n in ((1, 7), (2, 25), (3, 60)):
        rng = random.Random(seed)
        names = {(f"r{int(rng.paretovariate(0.6)) % 40:02d}", f"d{int(rng.paretovariate(0.5)) % 25:02d}"): None for _ in range(300)}
        pool = [(f"s{rng.randrange(4)}", r, d, rng.choice([0, 1, 2, 3, 9, None])) for r, d in names]
        assert draw(spark, pool, n, 2, 3) == plain_draw(pool, n, 2, 3, bands)


def test_greedy_draw_keeps_the_budget_and_empty_pools(spark):
    pool = spark.createDataFrame([("x", f"r{i}", "a") for i in range(1000)] + [("x", "zzz", "b")], "s string, r string, d string")
    quotas = spark.createDataFrame([("x", 9)], "s string, quota int")
    got = [tuple(r) for r in draws.greedy_draw(pool, quotas, "s", "r", "d", 2, 10, 4).collect()]
    assert len(got) == 4 and ("x", "zzz", "b") in got
    assert draws.greedy_draw(pool.limit(0), quotas, "s", "r", "d", 2, 10, 4).count() == 0
    none = spark.createDataFrame([(None, "r", "d", 1), ("s", None, "d", 1)], "s string, r string, d string, f int")
    assert draws.stratified_draw(none, "s", "r", "d", "f", 3, 1, 1, spark_bands).count() == 0


def test_phantoms_against_plain_closures(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        declared = {(f"s{rng.randrange(6)}", rng.randrange(30)) for _ in range(40)} | {("hub", i) for i in range(12)}
        requires = {(rng.randrange(30), rng.randrange(36)) for _ in range(45)} | {(3, 3), (4, 5), (5, 4)}

        def reached(start, depth):
            seen, front = {}, {start}
            for hop in range(1, depth + 1):
                front = {b for a, b in requires if a in front}
                for x in front:
                    seen.setdefault(x, hop)
            return seen

        for depth in (1, 2, 6):
            want = set()
            for s, d in declared:
                ways = [(o, reached(o, depth)[d]) for x, o in declared if x == s and o != d and d in reached(o, depth)]
                if ways:
                    want.add((s, d, min(w[0] for w in ways), min(w[1] for w in ways)))
            got = graph.phantoms(spark.createDataFrame(sorted(declared), "src string, dst int"), spark.createDataFrame(sorted(requires), "src int, dst int"), depth)
            assert {tuple(r) for r in got.collect()} == want
    none = spark.createDataFrame([(None, 1), ("s", None)], "src string, dst int")
    assert graph.phantoms(none, none.select(F.col("dst").alias("src"), "dst")).count() == 0


def test_closures_of_many_seeds(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", None), (None, "y")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (1, "d"), (2, "c"), (3, "zz"), (4, None)], "k int, node string")
    got = {tuple(r) for r in graph.closures(links, seeds, ["k"], 2).collect()}
    assert got == {(1, "a", 0), (1, "d", 0), (1, "b", 1), (1, "c", 2), (2, "c", 0), (2, "a", 1), (2, "d", 1), (2, "b", 2), (3, "zz", 0)}


def test_closure_report(spark):
    subs = [(1, "Dep", True, True, True), (2, "dep", False, True, True), (3, "dep", True, False, True), (4, "pip", True, True, True), (5, "dep", True, True, True), (6, "dep", True, True, True), (7, None, True, True, True), (8, "dep", True, True, False), (9, "dep", False, False, True)]
    declared = [(k, side, name) for k in range(1, 9) for side, name in (("before", "dep"), ("before", "keep"), ("after", "keep"))] + [(5, "after", "DEP"), (6, "after", "new.one"), (6, "after", "pytest"), (4, "before", "pip")]
    declared = [r for r in declared if not (r[0] == 8 and r[2] == "dep")]
    observed = [(9, "before", "dep"), (9, "before", "gone"), (9, "after", "keep"), (1, "before", "ignored")]
    df = spark.createDataFrame(subs, "k int, t string, edited boolean, applied boolean, gold boolean")
    sides = lambda rows: spark.createDataFrame(rows, "k int, side string, name string")
    got = {r.k: r for r in gates.closure_report(df, "k", "t", sides(declared), sides(observed)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "pass", 2: "fail", 3: "fail", 4: "unverified", 5: "fail", 6: "fail", 7: "unverified", 8: "pass", 9: "fail"}
    assert got[6].added == ["new_one"] and got[5].target_still_present and got[9].mode == "observed" and got[9].removed == ["gone"] and got[1].mode == "declared"
    links = spark.createDataFrame([("keep", "one"), ("one", "two"), ("two", "Dep")], "src string, dst string")
    deep = {r.k: r for r in gates.closure_report(df, "k", "t", sides(declared), sides(observed), links).collect()}
    assert deep[1].status == "fail" and deep[1].reason == "dep is still there" and deep[1].mode == "metadata" and deep[1].n_after == 4


def test_value_classes_of_maps_and_mixed_containers(spark):
    opaque, exact = '{"t":"Foo","r":"<f>"}', '{"t":"int","v":1}'
    rows = [
        (f'{{"t":"dict","n":1,"items":[[{exact},{opaque}]]}}', "opaque", "opaque"),
        (f'{{"t":"dict","n":1,"items":[[{opaque},{exact}]]}}', "exact", "exact"),
        (f'{{"t":"list","n":2,"items":[{exact},{opaque}]}}', "opaque", "exact"),
        (f'{{"t":"list","n":3,"items":[{exact},{opaque}]}}', "truncated", "truncated"),
        ('{"t":"list","n":2,"items":[{"t":"str","v":"a","n":5},1]}', "truncated", "truncated"),
        ('{"t":"list","n":0,"items":[]}', "exact", "exact"),
        ('{"t":"x","h":null}', "hashed", "hashed"),
        ('{"list":[]}', "array", "array"),
        ("null", "exact", "exact"),
        ("{broken", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, worst string, best string")
    for r in df.select("*", *[traces.value_class(F.col("v"), mixed=m).alias(f"got_{m}") for m in ("worst", "best")]).collect():
        assert (r.got_worst, r.got_best) == (r.worst, r.best), r


def test_grades(spark):
    rows = [(1, "G2", "pass", "r"), (1, "G7", None, "r"), (2, "G7", "fail", "x" * 300), (2, "G2", "unverified", None), (3, "G3", "fail", ""), (3, "G2", "fail", "y"), (4, "G2", None, None)]
    got = {r.k: r for r in reports.grade(spark.createDataFrame(rows, "k int, g string, s string, r string"), "k", "g", "s", "r").collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].accepted and got[1].rests_on is None and [tuple(x) for x in got[1].reasons] == [("G2", "r")]
    assert (got[2].failed, got[2].unverified, got[2].rests_on, got[2].unstated) == (["G7"], ["G2"], "unstated constraint only", ["G7"]) and len(got[2].reasons[1].reason) == 160
    assert (got[3].failed, got[3].rests_on, got[3].unstated) == (["G2", "G3"], "tests or behaviour", ["G3"])


def test_leaks_and_second_sources(spark):
    files = [("t", "patch.diff", None), ("t", "x/patch.diff", "no"), ("t", "x/usage.jsonl/a", "_b_"), ("t", ".git/conftest.py", "_b_"), ("t", "conftest.py", "_r_ _b_"), ("t", "a/b.py", "_r_"), ("t", "a/b.bin", "_r_"), ("t", "c.py", None)]
    df = spark.createDataFrame(files, "t string, p string, x string")
    got = {(r.p, r["class"], r.at_root) for r in reports.leaks(df, "t", "p", "x", ["patch.diff", "usage.jsonl"], [("block", "_b_"), ("recorder", "_r_")], ["conftest.py"], [".py"]).collect()}
    assert got == {("patch.diff", "artefact", True), ("x/usage.jsonl/a", "artefact", False), ("conftest.py", "block", True), ("a/b.py", "recorder", False)}
    trees = spark.createDataFrame([("t", "tox.ini", "dep_a\n"), ("t", "sub/requirements.txt", "DEP-A==1"), ("t", "requirements-b.txt", "dep-ab\n# dep-a"), ("t", "requirements.txt", "dep-a"), ("t", "a/b/requirements.txt", "dep-a"), ("u", "tox.ini", None)], "t string, p string, x string")
    wanted = spark.createDataFrame([("t", "Dep-A", "requirements.txt", "run tox.ini"), ("u", "q", None, None)], "t string, d string, b string, ci string")
    found = lambda w: [tuple(r) for r in reports.install_sources(trees, w, "t", "p", "x", "d", "b", "ci", ["^requirements", "^tox.ini$"]).collect()]
    assert found(wanted) == [("t", "Dep-A", "tox.ini", True)]
    assert found(wanted.withColumn("b", F.lit("setup.py")).withColumn("ci", F.lit(None).cast("string"))) == [("t", "Dep-A", "requirements.txt", False)]


def test_totals_and_units_of_empty_tables(spark):
    none = spark.createDataFrame([], "i int, f string, v boolean")
    assert tuple(reports.mutation_totals(none, "i", F.col("v")).first()) == (0, 0, 0, 0, 0.0, 0.0)
    assert {r.unit: (r.n, r.rate_of_all) for r in reports.outcome_units(none, "i", "f", F.col("v"), ~F.col("v")).collect()} == {"function": (0, 0.0), "item": (0, 0.0)}
    rows = spark.createDataFrame([(1, "f", True), (1, "f", False), (1, "g", None), (2, "f", False), (2, "g", None)], "i int, f string, v boolean")
    assert {r.unit: tuple(r)[1:5] for r in reports.outcome_units(rows, "i", "f", F.col("v"), ~F.col("v")).collect()} == {"function": (4, 1, 1, 2), "item": (2, 1, 1, 0)}
    assert tuple(reports.mutation_totals(rows, "i", F.col("v")).first())[:4] == (2, 1, 5, 1)


def test_draw_in_tasks_of_bounded_rows(spark, monkeypatch):
    import random

    monkeypatch.setattr(graph, "PER_TASK", 30)
    rng = random.Random(4)
    pool = [("x" if rng.random() < 0.9 else "y", f"r{rng.randrange(300):03d}", f"d{i:03d}", rng.choice([0, 1, 9, None])) for i in range(600)]
    assert draw(spark, pool, 4, 1, 1) == plain_draw(pool, 4, 1, 1, bands)
    rows = spark.createDataFrame([(*p, bands(p[3])) for p in pool], "s string, r string, d string, f long, b string")
    first = draws._candidates(rows, 1)
    want = {}
    for p in sorted(pool, key=lambda p: (p[1], p[2])):
        mine = want.setdefault((p[0], bands(p[3])), [])
        if sum(m[1] == p[1] for m in mine) < 2 and len(mine) < 9:
            mine.append(p)
    assert {tuple(r)[:4] for r in first.select("s", "r", "d", "f").collect()} == {p for rows in want.values() for p in rows}
    assert ", 20\n" in first._jdf.queryExecution().optimizedPlan().toString()
