import io
import random
import tarfile
import zipfile
import zlib
from collections import Counter

import pytest
from assay.functions import code, names
from assay.operators import census, copies, draws, gates, graph, relate, statistics, text, traces
from assay.plans.audits import QUERIES, code_copy_scores
from assay.sinks import writers
from assay.sources import files, manifests
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_lines_that_look_like_headers_stay_in_their_hunk(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n--- x\n+++ counter\n same\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n-a\n+b\n"
    df = spark.createDataFrame([(1, patch), (2, "+loose\n-line\n ctx\n"), (3, None), (4, "")], "id int, patch string")
    got = {(r.id, r.path, r.kind, r.text) for r in text.diff_rows(df, "id", "patch").collect()}
    assert got == {(1, "x.py", "del", "-- x"), (1, "x.py", "add", "++ counter"), (1, "x.py", "ctx", "same"), (1, "y.py", "del", "a"), (1, "y.py", "add", "b"), (2, None, "add", "loose"), (2, None, "del", "line"), (2, None, "ctx", "ctx")}


def test_code_tokens(spark):
    df = spark.createDataFrame([("def f(x):  # note\n    return \"a # b\" + 'c' + 0x1f * été",)], "s string")
    assert df.select(code.code_tokens(F.col("s"))).first()[0] == ["def", "I", "(", "I", ")", ":", "return", "S", "+", "S", "+", "N", "*", "I"]


def test_winnowed_code_with_crc32_against_plain_python(spark):
    rng = random.Random(4)
    words = ["if", "return", "(", ")", "+", "x1", "7", "'s'", "for", "in", ":"]
    source = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lib = source(200)
    docs = [(1, lib), (2, lib[: len(lib) // 2] + " " + source(60)), (3, source(150)), (4, "x"), (5, "")]
    kind = lambda w: "I" if w == "x1" else "N" if w == "7" else "S" if w == "'s'" else w

    def prints(s):
        toks = [kind(w) for w in s.split() if w]
        hs = [zlib.crc32(" ".join(toks[i : i + 16]).encode()) for i in range(len(toks) - 15)]
        return set(hs) if len(hs) <= 8 else {min(hs[i : i + 8]) for i in range(len(hs) - 7)}

    got = {r.doc_id: (r.tokens, r.containment) for r in code_copy_scores(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, lib)], "item_id int, text string"), "doc_id", "item_id").collect()}
    for i in (1, 3, 4, 5):
        p, own = prints(dict(docs)[i]), prints(lib)
        assert got[i][1] == pytest.approx(len(p & own) / len(p) if p else 0.0)
    assert got[1][1] == 1.0 and 0.2 < got[2][1] < 1


def test_copy_verdict(spark):
    rows = [(1, "some-lib", None, None, None, None), (2, "some-lib", "somelib/a.py", "added", 5, 0.0), (3, "l", "src/a.py", "added", 100, None), (4, "l", "src/a.py", "added", 100, 0.6), (5, "l", "src/a.py", "modified", 59, 1.0)]
    got = {r.id: r.status for r in gates.copy_verdict(spark.createDataFrame(rows, "id int, dep string, path string, change string, tokens int, containment double"), "id", "dep").collect()}
    assert got == {1: "pass", 2: "fail", 3: "unverified", 4: "fail", 5: "pass"}


def test_phantom_patterns(spark):
    logs = [("Successfully installed flask-cors-3.0", "fail"), ("pyproject-flask-cors-1", "pass"), ("Flask_Cors==2", "fail"), ("Requirement already satisfied: flask.cors in x", "fail"), ("Installing flask-cors (3.1)", "fail"), (" ", "unverified"), (None, "unverified")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(logs)], "id int, log string")
    got = {r.id: r.status for r in gates.phantom_gate(df, "id", "log", code.installed_pattern(F.lit("flask-cors"))).collect()}
    assert got == {i: s for i, (_, s) in enumerate(logs)}


def test_greedy_draw_against_plain_python(spark):
    rng = random.Random(2)
    pool = sorted({(f"s{rng.randrange(3)}", f"r{rng.randrange(9)}", f"d{rng.randrange(6)}") for _ in range(80)})
    quota = {"s0": 6, "s1": 7, "s2": 5}
    repos, deps, want = Counter(), Counter(), set()
    for s in sorted(quota, key=lambda s: (sum(p[0] == s for p in pool), s)):
        left = [p[1:] for p in pool if p[0] == s]
        for _ in range(quota[s]):
            fit = [p for p in left if repos[p[0]] < 2 and deps[p[1]] < 4]
            if not fit:
                break
            pick = min(fit, key=lambda p: (repos[p[0]], deps[p[1]], p))
            left.remove(pick)
            repos[pick[0]] += 1
            deps[pick[1]] += 1
            want.add((s, *pick))
    got = draws.greedy_draw(spark.createDataFrame(pool, "s string, r string, d string"), spark.createDataFrame(list(quota.items()), "s string, quota int"), "s", "r", "d", 2, 4, 18)
    assert {tuple(r) for r in got.collect()} == want and want
    drawn = QUERIES["greedy_draw"](spark, DATA).collect()
    assert len(drawn) == len(set(drawn)) and max(Counter(r.repo for r in drawn).values()) <= 2


def test_best_match_against_all_pairs(spark):
    rng = random.Random(7)
    side = lambda n: {i: {f"t{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randint(1, 12))} for i in range(n)}
    a, b = side(40), side(25)
    rows = lambda s, k: spark.createDataFrame([(i, w) for i, ws in s.items() for w in ws], f"{k} int, w string")
    for least in (0.2, 0.5, 1.0):
        want = {}
        for i, x in a.items():
            best = max(((len(x & y) / len(x | y), -j) for j, y in b.items()), default=None)
            if best and best[0] >= least:
                want[i] = -best[1]
        assert {r.a: r.b for r in relate.best_match(rows(a, "a"), rows(b, "b"), "a", "b", "w", least).collect()} == want


def test_order_statistics(spark):
    v = [3, 1, None, 2, 2, 9, 9]
    ranks = {"mid": statistics.upper_median_rank(), "q": statistics.quantile_rank(0.9)}
    df = spark.createDataFrame([(x,) for x in v], "v int")
    assert tuple(statistics.order_statistics(df, "v", ranks).first()) == (3, 9)
    assert tuple(statistics.order_statistics(df.limit(0), "v", ranks).first()) == (None, None)


def test_closures(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert {tuple(r) for r in graph.bounded_closure(e, 2).collect()} == {(1, 2), (1, 3), (2, 3), (2, 1), (2, 4), (3, 1), (3, 4), (3, 2)}


def test_manifest_sources_edits_masks_and_archives(spark, tmp_path):
    inline = spark.createDataFrame([("q/requirements.txt", "a\nb>1\n"), ("q/package.json", '{"dependencies": {"x": "1", "y": "2"}}'), ("q/setup.cfg", "[options]\ninstall_requires = one\n"), ("q/none.md", "x"), ("q/requirements-x.txt", None)], "path string, text string")
    masked = {r.path: r.text for r in manifests.masked(inline).collect()}
    assert masked["q/requirements.txt"] == "" and '"x"' not in masked["q/package.json"] and masked["q/none.md"] is None
    gone = manifests.without(inline.withColumn("n", F.lit("B")), "n").where("text IS NOT NULL").collect()
    assert [(r.path, r.text) for r in gone] == [("q/requirements.txt", "a\n")]
    inc = spark.createDataFrame([("a/r.in", "-r b.in\nx\n"), ("a/b.in", "y\n-r r.in\n")], "path string, text string").withColumn("path", F.concat(F.lit("z/requirements/"), "path"))
    assert manifests.with_included(inc.withColumn("path", F.regexp_replace("path", "[.]in$", ".in"))).count() == 0  # names of no known format
    named = spark.createDataFrame([("requirements.txt", "-r requirements-b.txt\nx\n"), ("requirements-b.txt", "y\n-r requirements.txt\n")], "path string, text string")
    assert {tuple(r)[:2] for r in manifests.with_included(named).collect()} == {(p, n) for p in ("requirements.txt", "requirements-b.txt") for n in "xy"}
    with zipfile.ZipFile(tmp_path / "a.whl", "w") as z:
        z.writestr("m/a.py", "1")
        z.writestr("m/b.txt", "2")
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        info = tarfile.TarInfo("c.py")
        info.size = 1
        t.addfile(info, io.BytesIO(b"3"))
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no")
    assert {(r.member, r.text) for r in files.archive_members(spark, str(tmp_path)).collect()} == {("m/a.py", "1"), ("c.py", "3")}


def test_file_sources_and_sinks(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "w.json").write_text('{"rows": [{"a": 3}]}')
    assert sorted(r.a for r in files.wrapped_rows(spark, str(tmp_path), "a int", "rows").collect()) == [1, 2, 3]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.tsv").write_text("# c\na\tb\nc\td\te\tf\n")
    assert sorted(map(tuple, files.ragged_tsv(spark, str(tmp_path / "t"), ["p", "q", "r"]).collect())) == [("a", "b", ""), ("c", "d", "e")]
    logs = spark.createDataFrame([("r/2.log", "b"), ("r/1.log", "a"), ("s/1.log", "c")], "path string, text string")
    assert {tuple(r) for r in files.joined_logs(logs, F.split_part("path", F.lit("/"), F.lit(1))).collect()} == {("r", "a\nb"), ("s", "c")}
    tree = spark.createDataFrame([("a.py",), (".x/b.py",), ("venv/c.py",), ("d/e.py",)], "path string")
    assert sorted(r.path for r in files.source_files(tree).collect()) == ["a.py", "d/e.py"]
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, n int")
    writers.summary_and_rows(rows.agg(F.sum("n").alias("n")), rows, str(tmp_path / "s"))
    writers.append_json_lines(rows, str(tmp_path / "j"))
    writers.append_json_lines(rows, str(tmp_path / "j"))
    writers.csv(rows, str(tmp_path / "c"), ["n", "missing"])
    writers.folder_per_key(rows, str(tmp_path / "p"), ["k"])
    assert spark.read.json(str(tmp_path / "s/summary")).first().n == 3 and spark.read.json(str(tmp_path / "j")).count() == 4
    assert files.csv_rows(spark, str(tmp_path / "c")).columns == ["n", "missing"] and spark.read.json(str(tmp_path / "p")).count() == 2


def test_value_classes(spark):
    rows = [('{"t":"int","v":1}', "exact"), ('"plain"', "exact"), ('{"t":"str","v":"a","n":5}', "truncated"), ('{"t":"list","n":3,"items":[{"t":"int"}]}', "truncated"), ('{"t":"X","attrs":{}}', "structural"), ('{"t":"list","n":1,"items":[{"t":"list","n":1,"items":[{"t":"X","r":"<x>"}]}]}', "opaque")]
    df = spark.createDataFrame(rows, "v string, want string")
    assert [r.c for r in df.select("want", traces.value_class(F.col("v")).alias("c")).collect()] == [w for _, w in rows]


def test_word_is_taken_literally(spark):
    df = spark.createDataFrame([("a.b",), ("axb",)], "s string")
    assert [r[0] for r in df.select(names.whole_word(F.col("s"), "a.b")).collect()] == [True, False]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, patch string, dep string")
    assert gates.oracle_gate(none, "id", "patch", "dep").count() == 0 and text.added_text(none, "id", "patch").count() == 0
    assert copies.library_containment(spark.createDataFrame([], "k int, print string"), spark.createDataFrame([], "print string"), "k").count() == 0
