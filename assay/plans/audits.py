"""Further queries of the catalogue: gates, diffs, code copies, manifests, traces, censuses, sampling, set tests, sinks.

Documents stand for patches and logs, suppliers for submissions, parts for packages, events for recorded calls. Diffs and
manifests are made from the tables' rows, or are a few inline files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code, names
from ..operators import census, copies, draws, gates, graph, text, traces
from ..sinks import writers
from ..sources import manifests
from .catalogue import QUERIES, query, t


def _patches(spark, sf_dir) -> DataFrame:
    """A patch for each document: a counter is changed in a test file by lines that look like file headers, and a new module
    holds the document."""
    body = F.regexp_replace(F.regexp_replace("text", r"\r\n|\r", "\n"), r"\n\z", "")
    n = F.size(F.split(body, "\n"))
    name = F.concat(F.lit("src/m"), F.col("doc_id"), F.lit(".py"))
    head = "diff --git a/tests/test_c.py b/tests/test_c.py\n--- a/tests/test_c.py\n+++ b/tests/test_c.py\n@@ -1,3 +1,4 @@\n keep\n--- counter\n-    assert x\n+++ counter\n+@pytest.mark.skip\n+    assert y\n"
    new = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1,"), n, F.lit(" @@\n+"), F.replace(body, F.lit("\n"), F.lit("\n+")), F.lit("\n"))
    return t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(head), new).alias("patch"), "lang", body.alias("body"))


_BODY = r"b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n\z', '') AS body FROM documents)"


@query(rf"""WITH {_BODY} SELECT doc_id, 'src/m' || doc_id || '.py' AS path, len(string_split(body, chr(10)))::BIGINT AS added, 0::BIGINT AS deleted, true AS new_file, false AS deleted_file FROM b
UNION ALL SELECT doc_id, 'tests/test_c.py', 3, 2, false, false FROM b""")
def diff_files(spark, sf_dir):
    return text.file_changes(_patches(spark, sf_dir), "doc_id", "patch")


@query(rf"""WITH {_BODY} SELECT doc_id, 'src/m' || doc_id || '.py' AS path, 'added' AS change, sha1(body) AS digest FROM b
UNION ALL SELECT doc_id, 'tests/test_c.py', 'modified', sha1('++ counter' || chr(10) || '@pytest.mark.skip' || chr(10) || '    assert y') FROM b""")
def added_python(spark, sf_dir):
    return text.added_text(_patches(spark, sf_dir), "doc_id", "patch").select("doc_id", "path", "change", F.sha1("text").alias("digest"))


@query(rf"""WITH {_BODY} SELECT doc_id, sha1('diff --git a/src/m' || doc_id || '.py b/src/m' || doc_id || '.py' || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/src/m' || doc_id || '.py' || chr(10)
|| '@@ -0,0 +1,' || len(string_split(body, chr(10))) || ' @@' || chr(10) || '+' || replace(body, chr(10), chr(10) || '+')) AS digest FROM b""")
def injected_hunks_elided(spark, sf_dir):
    return text.elided_digest(_patches(spark, sf_dir), "doc_id", "patch", ["test_c.py"])


@query(rf"""WITH {_BODY} SELECT doc_id, (len(string_split(body, chr(10))) + 6)::BIGINT AS crlf FROM b WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 6 FROM b WHERE doc_id % 2 <> 0""")
def matched_line_ends(spark, sf_dir):
    """Hunk lines that end in CR LF, where every test file has such ends, and the modules of even documents."""
    p = _patches(spark, sf_dir)
    crlf = p.select("doc_id", F.lit("tests/test_c.py").alias("path")).unionByName(p.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("src/m"), "doc_id", F.lit(".py")).alias("path")))
    found = text.matched_line_ends(p, "doc_id", "patch", crlf)
    return found.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\r"), F.lit("")))).cast("long").alias("crlf"))


@query("SELECT doc_id, 'fail' AS status, 'skip added' AS signals FROM documents")
def oracle_untouched(spark, sf_dir):
    return gates.oracle_gate(_patches(spark, sf_dir), "doc_id", "patch").select("doc_id", "status", "signals")


_GATE_CASES = [
    ("new test", "--- /dev/null\n+++ b/tests/test_n.py\n@@ -0,0 +1 @@\n+def test_n(): assert 1\n"),
    ("deleted test", "--- a/tests/test_o.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-def test_o(): assert 1\n"),
    ("test removed", "--- a/tests/test_o.py\n+++ b/tests/test_o.py\n@@ -1,2 +1 @@\n-def test_o():\n-    x = 1\n+x = 1\n"),
    ("emptied", "--- a/test_o.py\n+++ b/test_o.py\n@@ -1,2 +1,2 @@\n def test_o():\n-    assert f() == 2\n+    pass\n"),
    ("parameters", "--- a/test_o.py\n+++ b/test_o.py\n@@ -1,2 +1 @@\n-@pytest.mark.parametrize('a', [1])\n def test_o(a):\n"),
    ("workflow", "--- a/.github/workflows/ci.yml\n+++ b/.github/workflows/ci.yml\n@@ -1 +1 @@\n-  - run: pytest\n+  - run: true\n"),
    ("dependency out of tox", "--- a/tox.ini\n+++ b/tox.ini\n@@ -1,2 +1 @@\n deps =\n-    some-lib\n"),
    ("hook", "--- a/conftest.py\n+++ b/conftest.py\n@@ -1 +1,2 @@\n x = 1\n+collect_ignore = ['test_o.py']\n"),
    ("stronger test", "--- a/test_o.py\n+++ b/test_o.py\n@@ -1 +1,2 @@\n def test_o():\n+    assert g()\n"),
    ("source only", "--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n-assert x\n+pass\n"),
]
_GATE_WANT = {"deleted test": "test file deleted", "test removed": "test function removed", "emptied": "assertions removed,test body emptied", "parameters": "parametrisation removed", "workflow": "runner configuration edited", "hook": "collection hook added"}


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({', '.join(map(cell, r))})" for r in rows) + ")"


@query(f"SELECT id, status, signals FROM {_values([(c, 'fail' if c in _GATE_WANT else 'pass', _GATE_WANT.get(c, '')) for c, _ in _GATE_CASES])} v(id, status, signals)")
def oracle_gate_cases(spark, sf_dir):
    """Attacks, each beside an edit that must pass."""
    cases = spark.createDataFrame([(c, p, "some_lib") for c, p in _GATE_CASES], "id string, patch string, dep string")
    return gates.oracle_gate(cases, "id", "patch", "dep").select("id", "status", "signals")


# Submissions: a supplier gives up its part of the smallest key. Declared before: its parts in orders that were finished or
# open; after: what is left by a rule that leaves some submissions right and some wrong.
_DECLARED = """d AS (SELECT l_suppkey AS k, l_partkey AS p, bool_or(l_linestatus = 'F') AS f, bool_or(l_linestatus = 'O') AS o FROM lineitem GROUP BY 1, 2),
w AS (SELECT k, min(p) AS target, count(*) AS n, count(*) FILTER (f) AS nb, count(*) FILTER (o) AS na, count(*) FILTER (f AND NOT o) AS gone, count(*) FILTER (o AND NOT f) AS came FROM d GROUP BY 1),
x AS (SELECT w.*, bool_or(d.f) AS tb, bool_or(d.o) AS ta FROM w JOIN d ON d.k = w.k AND d.p = w.target GROUP BY ALL)"""


def _declared(spark, sf_dir) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p"), "l_linestatus")
    dealt = rows.repartition(graph.parts(spark, rows.count()), "k")
    return dealt.groupBy("k", "p").agg(F.bool_or(F.col("l_linestatus") == "F").alias("f"), F.bool_or(F.col("l_linestatus") == "O").alias("o"))


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = _declared(spark, sf_dir).withColumn("name", F.concat(F.lit("Part-"), "p"))
    return d.where("f"), d.where("o"), d.groupBy("k").agg(F.concat(F.lit("part_"), F.min("p")).alias("target"))


@query(f"WITH {_DECLARED} SELECT k, CASE WHEN NOT tb THEN 'unverified' WHEN ta OR came > (ta AND NOT tb)::INT THEN 'fail' ELSE 'pass' END AS status, came - (ta AND NOT tb)::INT AS added, ta AS still_present FROM x")
def closure_not_grown(spark, sf_dir):
    before, after, targets = _sides(spark, sf_dir)
    return gates.closure_gate(before, after, targets, "k", "name", "target")


def _arrays(spark, sf_dir) -> DataFrame:
    before, after, targets = _sides(spark, sf_dir)
    lists = lambda d, name: d.groupBy("k").agg(F.collect_set("name").alias(name))  # noqa: E731 (one submission's declarations)
    return targets.join(lists(before, "b"), "k", "left").join(lists(after, "a"), "k", "left")


@query(f"""WITH {_DECLARED} SELECT k, CASE WHEN nb = 0 OR na = 0 THEN 'unverified' WHEN NOT ta AND came = 0 AND gone = 1 AND tb THEN 'pass' ELSE 'fail' END AS status,
CASE WHEN nb = 0 OR na = 0 THEN 'the manifest could not be read' WHEN ta THEN 'still declared' WHEN came = 0 AND gone = 1 AND tb THEN 'removed' ELSE 'other declarations changed too' END AS reason FROM x""")
def declaration_gone(spark, sf_dir):
    return gates.declaration_gate(_arrays(spark, sf_dir), "k", "b", "a", "target")


@query(f"""WITH {_DECLARED} SELECT k, came + (ta AND tb)::INT = 0 AS subset, came + (ta AND tb)::INT = 0 AND gone = (tb AND NOT ta)::INT AS shrunk, came = 0 AND gone = 0 AS equal FROM x WHERE nb > 0 AND na > 0""")
def set_tests(spark, sf_dir):
    rows = _arrays(spark, sf_dir).where("a IS NOT NULL AND b IS NOT NULL").withColumn("t", F.replace("target", F.lit("part_"), F.lit("Part-")))
    return census.set_tests(rows, "k", "b", "a", F.col("t"))


@query("""WITH d AS (SELECT DISTINCT user_id, event_type FROM events) SELECT d.user_id, d.event_type AS left_out, coalesce(string_agg(o.event_type, ',' ORDER BY o.event_type), '') AS rest
FROM d LEFT JOIN d o ON o.user_id = d.user_id AND o.event_type <> d.event_type GROUP BY 1, 2""")
def leave_one_out(spark, sf_dir):
    rows = t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("items"))
    return census.leave_one_out(rows, "user_id", "items").select("user_id", "left_out", F.array_join("rest", ",").alias("rest"))


def _stack(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    status = lambda c: F.when(c, "pass").when(~c, "fail").otherwise("unverified")
    return d.select("doc_id", "lang", gates.tests_gate(F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "error")).alias("G2"), F.when(F.col("lang") != "de", status(F.col("n_chars") >= 300)).alias("G3"), status(F.col("toxic") == 0).alias("G7"))


_STACK = """g AS (SELECT doc_id, lang, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'unverified' END AS g2, CASE WHEN lang <> 'de' THEN CASE WHEN n_chars >= 300 THEN 'pass' ELSE 'fail' END END AS g3,
CASE toxic WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unverified' END AS g7 FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""WITH {_STACK}, l AS (SELECT doc_id, concat_ws(',', CASE WHEN g2 = 'fail' THEN 'G2' END, CASE WHEN g3 = 'fail' THEN 'G3' END, CASE WHEN g7 = 'fail' THEN 'G7' END) AS failed,
concat_ws(',', CASE WHEN g2 = 'unverified' THEN 'G2' END, CASE WHEN g3 = 'unverified' THEN 'G3' END, CASE WHEN g7 = 'unverified' THEN 'G7' END) AS unverified, g2 FROM g)
SELECT doc_id, failed, unverified, failed = '' AND unverified = '' AS accepted, CASE WHEN g2 = 'fail' THEN 'tests or behaviour' WHEN failed <> '' THEN 'unstated constraint only' END AS rests_on FROM l""")
def gate_stack(spark, sf_dir):
    return gates.stack(_stack(spark, sf_dir), "doc_id", ["G2", "G3", "G7"])


@query(f"WITH {_STACK} " + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER ({g} = 'pass') AS passed, count(*) FILTER ({g} = 'fail') AS failed, count(*) FILTER ({g} = 'unverified') AS unverified, count(*) FILTER ({g} IS NULL) AS absent FROM g" for g in ("G2", "G3", "G7")))
def gate_coverage(spark, sf_dir):
    return census.gate_coverage(_stack(spark, sf_dir), ["G2", "G3", "G7"])


_CALLS = "c AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'usage' ELSE 'boundary' END AS level, (props->>'$.k')::INT AS k FROM events)"


@query(f"""WITH {_CALLS}, n AS (SELECT user_id, count(*) FILTER (level = 'usage' AND event_type <> 'view') AS nu, count(*) FILTER (level = 'boundary' AND event_type <> 'view') AS nb, count(*) FILTER (level = 'usage' AND event_type <> 'view' AND k > 90) AS bu,
count(*) FILTER (level = 'boundary' AND event_type <> 'view' AND k > 90) AS bb, count(*) FILTER (event_type = 'view') AS missing FROM c GROUP BY 1)
SELECT user_id, CASE WHEN nu > 0 THEN CASE WHEN bu > 0 THEN 'fail' ELSE 'pass' END WHEN nb > 0 THEN CASE WHEN bb > 0 THEN 'fail' ELSE 'pass' END ELSE 'unverified' END AS status,
CASE WHEN nu > 0 THEN 'usage' WHEN nb > 0 THEN 'boundary' END AS decided_at, nu + nb AS compared, missing FROM n""")
def recorded_behaviour(spark, sf_dir):
    """Views lack their counterpart; values over 90 differ."""
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    pairs = e.select("user_id", F.when(F.col("event_id") % 2 == 0, "usage").otherwise("boundary").alias("level"), F.when(F.col("event_type") != "view", F.col("k") <= 90).alias("equal"))
    return gates.behaviour_gate(pairs, "user_id", "level", "equal")


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS killed, count(*) FILTER (event_type = 'view') AS pseudo FROM events GROUP BY 1)
SELECT user_id, killed, pseudo, pseudo / nullif(killed + pseudo, 0)::DOUBLE AS fraction, CASE WHEN killed = 0 AND pseudo > 0 THEN 'fail' ELSE 'pass' END AS status FROM n""")
def extreme_mutation(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "click", "killed").when(F.col("event_type") == "view", "pseudo-tested").otherwise("skipped")
    return gates.mutation_gate(t(spark, sf_dir, "events").withColumn("outcome", outcome), "user_id", "outcome")


@query(r"""SELECT doc_id, CASE WHEN trim(body) = '' THEN 'unverified' WHEN regexp_matches(body, '(?i)(^|[^a-z0-9_.\-])the-\d|(^|[^a-z0-9_.\-])the==\d|requirement already satisfied: the($|[^a-z0-9_.\-])') THEN 'fail' ELSE 'pass' END AS status
FROM (SELECT doc_id, regexp_replace(text, '\. ', '==7 ') AS body FROM documents)""")
def phantom_use(spark, sf_dir):
    """Is the package `the` in an install log? Logs are the documents, the first sentence end of which pins a word."""
    logs = t(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.when(F.instr("text", ". ") > 0, F.concat(F.substring_index("text", ". ", 1), F.lit("==7 "), F.expr("substring(text, instr(text, '. ') + 2)"))).otherwise(F.col("text"))
    return gates.phantom_gate(logs.withColumn("log", first), "doc_id", "log", code.installed_pattern(F.lit("the")))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no rerun' WHEN o_orderstatus <> 'F' THEN 'rerun failed' WHEN o_orderpriority = '1-URGENT' THEN 'counted: block observed' WHEN o_totalprice < 50000 THEN 'counted: never imported' ELSE 'excluded: block not observed' END AS status FROM orders""")
def activation_rule(spark, sf_dir):
    ci = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail")
    return t(spark, sf_dir, "orders").select("o_orderkey", gates.activation_status(ci, F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") < 50000).alias("status"))


def _code_sql() -> str:
    token = code.TOKEN.replace("'", "''")
    words = ", ".join(f"'{k}'" for k in code.keyword.kwlist)

    def prints(table: str, key: str) -> str:
        return rf"""{table}_t AS (SELECT {key}, generate_subscripts(w, 1) AS pos, unnest(w) AS t FROM (SELECT {key}, list_filter(regexp_extract_all(text, '{token}'), lambda x: x[1] <> '#') AS w FROM {table})),
{table}_k AS (SELECT {key}, pos, CASE WHEN length(t) > 1 AND regexp_matches(t, '["'']') THEN 'S' WHEN regexp_matches(t, '^[0-9]') THEN 'N' WHEN regexp_matches(t, '^[A-Za-z_]') AND t NOT IN ({words}) THEN 'I' ELSE t END AS token FROM {table}_t),
{table}_g AS (SELECT {key}, pos, list(token) OVER v AS gram FROM {table}_k WINDOW v AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
{table}_h AS (SELECT {key}, pos, md5(array_to_string(gram, ' ')) AS h FROM {table}_g WHERE len(gram) = 16),
{table}_w AS (SELECT {key}, h, min(h) OVER v AS low, count(*) OVER v AS held, count(*) OVER (PARTITION BY {key}) AS n FROM {table}_h WINDOW v AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
{table}_p AS (SELECT DISTINCT {key}, CASE WHEN n <= 8 THEN h WHEN held = 8 THEN low END AS print FROM {table}_w WHERE n <= 8 OR held = 8)"""

    return f"""WITH {prints("documents", "doc_id")}, {prints("benchmark", "item_id")}, l AS (SELECT DISTINCT print FROM benchmark_p),
n AS (SELECT doc_id, count(*) AS tokens FROM documents_k GROUP BY 1), c AS (SELECT doc_id, count(l.print) / count(*)::DOUBLE AS share FROM documents_p p LEFT JOIN l ON l.print = p.print GROUP BY 1),
s AS (SELECT doc_id, coalesce(tokens, 0) AS tokens, coalesce(share, 0) AS share FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, CASE WHEN tokens >= 60 AND share >= 0.6 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN tokens >= 60 AND share >= 0.6 THEN 'copied files' ELSE 'no copied file' END AS reason, (tokens >= 60 AND share >= 0.6)::INT::BIGINT AS copies FROM s"""


def code_copy_scores(docs: DataFrame, library: DataFrame, key: str, library_key: str, digest=F.crc32) -> DataFrame:
    """(key, tokens, containment) of source texts in a library of source texts."""
    found = docs.select(key, copies.code_prints(F.col("text"), 16, 8, digest).alias("x")).select(key, F.col("x.tokens").alias("tokens"), F.col("x.prints").alias("prints"))
    lib = library.select(copies.code_prints(F.col("text"), 16, 8, digest)["prints"].alias("prints"))
    return copies.row_library_containment(found, lib, key, "tokens")


@query(_code_sql())
def no_vendored_copy(spark, sf_dir):
    scores = code_copy_scores(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), "doc_id", "item_id", F.md5)
    rows = scores.select("doc_id", F.lit("bench").alias("dep"), F.concat(F.lit("src/m"), "doc_id", F.lit(".py")).alias("path"), F.lit("added").alias("change"), "tokens", "containment")
    return gates.copy_verdict(rows, "doc_id", "dep")


# Manifests: inline files.
_FILES = [
    ("a/requirements.txt", "-r base.txt\nFlask[async]>=2.0 ; python_version > '3'\n# no\nrequests==2.31\n"),
    ("a/base.txt", "x\n"),
    ("b/pyproject.toml", '[project]\nname = "p"\ndynamic = ["dependencies"]\n[tool.poetry.dependencies]\npython = "^3.9"\nattrs = "^23"\nrich = {version = "13", optional = true}\n'),
    ("c/pyproject.toml", '[project]\ndependencies = [\n  "numpy>=1.2",\n  "scipy",\n]\n'),
    ("d/setup.cfg", "[metadata]\nname = d\n[options]\ninstall_requires =\n    click>=8\n    pyyaml\n"),
    ("e/setup.py", "from setuptools import setup\nREQS = ['six', 'lxml>=4']\nsetup(name='e', install_requires=REQS)\n"),
    ("f/package.json", '{\n "dependencies": {\n  "left-pad": "^1.0",\n  "react": "18"\n }\n}\n'),
    ("g/Cargo.toml", '[dependencies]\nserde = "1.0"\nrand = { version = "0.8" }\n'),
    ("h/app.csproj", '<Project xmlns="http://x"><!-- <PackageReference Include="Gone" /> --><ItemGroup><PackageReference Include="N.J" Version="13" /><PackageReference Update="U"><Version>2</Version></PackageReference><ProjectReference Include="../l.csproj" /></ItemGroup></Project>'),
    ("i/package-lock.json", '{"dependencies": {"z": "1"}}'),
    ("j/pyproject.toml", "[broken"),
]
_FOUND = [
    *[("a/requirements.txt", "Flask", ">=2.0"), ("a/requirements.txt", "requests", "==2.31"), ("b/pyproject.toml", "attrs", "^23"), ("b/pyproject.toml", "rich", "13")],
    *[("c/pyproject.toml", "numpy", ">=1.2"), ("c/pyproject.toml", "scipy", ""), ("d/setup.cfg", "click", ">=8"), ("d/setup.cfg", "pyyaml", ""), ("e/setup.py", "six", ""), ("e/setup.py", "lxml", ">=4")],
    *[("f/package.json", "left-pad", "^1.0"), ("f/package.json", "react", "18"), ("g/Cargo.toml", "serde", "1.0"), ("g/Cargo.toml", "rand", "0.8")],
    *[("h/app.csproj", "N.J", "13"), ("h/app.csproj", "U", "2"), ("h/app.csproj", "../l.csproj", "")],
]


def _inline(spark) -> DataFrame:
    return spark.createDataFrame(_FILES, "path string, text string")


@query(f"SELECT * FROM {_values(_FOUND)} v(path, name, specifier)")
def manifest_dependencies(spark, sf_dir):
    return manifests.declared(manifests.without_lock_files(_inline(spark)))


@query(f"SELECT path, count(*) AS dependencies FROM {_values(_FOUND)} v(path, name, specifier) GROUP BY 1")
def build_file_discovery(spark, sf_dir):
    return manifests.build_files(_inline(spark))


@query(f"""WITH v AS (SELECT * FROM {_values(_FOUND)} v(path, name, specifier)), d AS (SELECT path, min(name) AS gone FROM v WHERE path NOT LIKE 'h/%' AND path NOT LIKE 'f/%' GROUP BY 1)
SELECT v.path, d.gone, v.name, v.specifier FROM v JOIN d USING (path) WHERE v.name <> d.gone""")
def manifest_edit(spark, sf_dir):
    """Each manifest without its first dependency, read again."""
    first = manifests.declared(_inline(spark)).where("path NOT LIKE 'h/%' AND path NOT LIKE 'f/%'").groupBy("path").agg(F.min("name").alias("gone"))
    edited = manifests.without(_inline(spark).join(first, "path"), "gone")
    return manifests.declared(edited.where("text IS NOT NULL")).join(first, "path").select("path", "gone", "name", "specifier")


@query("SELECT * FROM (VALUES ('a', 'requests==2.31', 'Flask>=2.0' || chr(10) || 'requests==2.31' || chr(10))) v(k, last, text)")
def manifest_round_trip(spark, sf_dir):
    rows = manifests.declared(_inline(spark).where("path = 'a/requirements.txt'"))
    written = manifests.requirements_text(rows)
    return written.select(F.lit("a").alias("k"), F.element_at(F.split(F.rtrim("text", F.lit("\n")), "\n"), -1).alias("last"), "text")


@query("""SELECT lower(c_mktsegment) AS name, list_aggregate(list_sort(list_distinct(list_filter([lower(c_mktsegment), replace(lower(c_mktsegment), '-', '_'), replace(lower(c_mktsegment), '_', '-'), replace(lower(c_mktsegment), '_', ''), replace(lower(c_mktsegment), '-', '')], lambda x: length(x) >= 3))), 'string_agg', ',') AS spellings,
count(*) AS n FROM customer GROUP BY ALL""")
def spelling_variants(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("name"), F.array_join(F.array_sort(code.spelling_variants(F.col("c_mktsegment"))), ",").alias("spellings"))
    return c.groupBy("name", "spellings").agg(F.count("*").alias("n"))


# Traces.


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'click' AND event_id % 5 <> 0) AS calls, count(*) FILTER (event_type = 'click' AND event_id % 5 = 0) AS malformed, bool_or(event_type = 'view') AS loaded FROM events GROUP BY 1)
SELECT user_id, calls, malformed, CASE WHEN user_id % 7 = 0 THEN 'not green' WHEN calls > 0 THEN 'traced' WHEN loaded THEN 'loaded, no call' ELSE 'never loaded' END AS state FROM n""")
def trace_states(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("12:00 CALL:"), F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props")))).when(F.col("event_type") == "view", "recorder on").otherwise("noise")
    runs = e.select("user_id").distinct().withColumn("ci", F.when(F.col("user_id") % 7 != 0, "pass"))
    return traces.trace_states(e.select("user_id", line.alias("line")), runs, "user_id", "line", "CALL:", "recorder on", "ci")


def _value():
    k = F.get_json_object("props", "$.k").cast("int")
    number = F.concat(F.lit('{"t":"int","v":'), k.cast("string"), F.lit("}"))
    return (
        F.when(k % 6 == 0, number).when(k % 6 == 1, '{"t":"str","n":9,"v":"abc"}').when(k % 6 == 2, F.concat(F.lit('{"t":"list","n":2,"items":['), number, F.lit(',{"t":"Foo","len":3}]}')))
        .when(k % 6 == 3, '{"t":"ndarray","list":[1]}').when(k % 6 == 4, '{"t":"blob","h":"a1"}').otherwise('{"t":"Socket","r":"<s>"}')
    )


@query("""WITH c AS (SELECT CASE (props->>'$.k')::INT % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'truncated' WHEN 2 THEN 'structural' WHEN 3 THEN 'array' WHEN 4 THEN 'hashed' ELSE 'opaque' END AS class FROM events)
SELECT class, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM c GROUP BY 1""")
def trace_fidelity(spark, sf_dir):
    return traces.fidelity(t(spark, sf_dir, "events").select(_value().alias("value")), "value")


_OBSERVED = """c AS (SELECT user_id, event_type AS f, (props->>'$.k')::INT % 2 = 0 AS void, (props->>'$.k')::INT > 95 AS opaque FROM events),
f AS (SELECT user_id, f, bool_and(void) AS void, bool_or(opaque) AS opaque FROM c GROUP BY 1, 2), p AS (SELECT user_id, bool_or(NOT void AND NOT opaque) AS seen FROM f GROUP BY 1)"""


@query(f"""WITH {_OBSERVED} SELECT 'call' AS level, 'returns a value' AS what, count(*) FILTER (NOT void) AS n FROM c UNION ALL SELECT 'call', 'returns nothing', count(*) FILTER (void) FROM c
UNION ALL SELECT 'call', 'takes a live object', count(*) FILTER (opaque) FROM c UNION ALL SELECT 'call', 'arguments can be written down', count(*) FILTER (NOT opaque) FROM c
UNION ALL SELECT 'function', CASE WHEN void THEN 'returns nothing' WHEN opaque THEN 'takes a live object' ELSE 'observable' END, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'pair', CASE WHEN seen THEN 'observable' ELSE 'not observable' END, count(*) FROM p GROUP BY 2""")
def observability_levels(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("q", F.concat(F.lit("pkg.mod."), "event_type"))
    return traces.observability(e, "user_id", "q", F.col("k") % 2 == 0, F.col("k") > 95)


@query("""WITH e AS (SELECT 'f.py:' || (user_id % 50) AS site, (props->>'$.k')::INT AS v, event_id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY event_id) AS nth FROM e),
m AS (SELECT 'f.py:' || (split_part(site, ':', -1)::INT + 1) AS site, v, nth FROM n) SELECT (SELECT count(*) FROM n WHERE v IS NOT NULL) AS as_recorded, (SELECT count(*) FROM n JOIN m USING (site, nth) WHERE n.v = m.v) AS shifted""")
def shift_sensitivity(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.concat(F.lit("f.py:"), F.col("user_id") % 50).alias("site"), F.get_json_object("props", "$.k").cast("int").alias("v"), "event_id")
    return traces.shift_sensitivity(e, e, "site", "event_id", "v", 1)


@query("""WITH k AS (SELECT user_id, event_type, (props->>'$.k')::INT AS v FROM events), f AS (SELECT user_id, max(v) AS fake FROM k WHERE event_type = 'click' GROUP BY 1), r AS (SELECT * FROM k WHERE event_type = 'view')
SELECT user_id, count(v) AS n, count(*) FILTER (v = fake) AS equal, count(v) > 0 AND count(*) FILTER (v = fake) = 0 AS convincing FROM f LEFT JOIN r USING (user_id) GROUP BY 1""")
def counterfeit_check(spark, sf_dir):
    k = t(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("v"))
    return traces.counterfeits(k.where("event_type = 'click'").groupBy("user_id").agg(F.max("v").alias("fake")), k.where("event_type = 'view'"), "user_id", "fake", "v")


@query("""WITH e AS (SELECT l_suppkey, p_brand || '.f' || l_partkey AS callee, p_brand AS root FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT root, count(DISTINCT callee) AS symbols, count(*) AS sites FROM e WHERE root NOT IN (SELECT p_brand FROM part WHERE p_size = 1) GROUP BY 1""")
def external_roots(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    e = t(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", F.concat("p_brand", F.lit(".f"), "l_partkey").alias("callee"))
    return traces.external_roots(e, p.where("p_size = 1"), "l_suppkey", "callee", "p_brand")


@query("""SELECT DISTINCT l_suppkey || '.py' AS src, CASE WHEN l_partkey % 3 = 0 THEN 'p/sub.py' ELSE 'p/__init__.py' END AS dst FROM lineitem""")
def module_graph(spark, sf_dir):
    """Suppliers' files import p.sub.m<key> or p.m<key>; the longest known module wins."""
    name = F.concat(F.when(F.col("l_partkey") % 3 == 0, "p.sub.m").otherwise("p.m"), "l_partkey")
    imports = t(spark, sf_dir, "lineitem").select(F.concat("l_suppkey", F.lit(".py")).alias("path"), name.alias("imported"))
    modules = spark.createDataFrame([("p/__init__.py", "p"), ("p/sub.py", "p.sub"), ("q.py", "q")], "path string, module string")
    return traces.module_edges(imports, modules, "path", "imported", "module")


@query("""WITH u AS (SELECT DISTINCT l_partkey % 20 AS dep, l_suppkey AS f FROM lineitem) SELECT 'd' || dep AS dep, count(*) FILTER (f % 4 <> 0) AS files, count(*) FILTER (f % 4 = 0) AS test_files FROM u GROUP BY 1 UNION ALL SELECT 'unused', 0, 0""")
def footprint(spark, sf_dir):
    """Each package is imported under two names."""
    path = F.concat(F.when(F.col("l_suppkey") % 4 == 0, "tests/").otherwise("src/"), "l_suppkey", F.lit(".py"))
    imports = t(spark, sf_dir, "lineitem").select(path.alias("path"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b"), F.col("l_partkey") % 20, F.lit(".x")).alias("imported"))
    aliases = spark.createDataFrame([(f"d{i}", f"{c}{i}") for i in range(20) for c in "ab"] + [("unused", "nowhere")], "dep string, alias string")
    return traces.footprint(imports, aliases, names.is_test_path(F.col("path")), "path", "imported", "dep", "alias")


_FOLDERS = ("", "src/", "tests/", "unittest/", "unit_tests/", "a/testing/b/", "test_data/", "latest/")
_FILE_NAMES = ("test_a.py", "test_a.txt", "a_test.py", "conftest.py", "my_conftest.py", "tests.py", "test", "a.py")


@query(f"""WITH p AS (SELECT {list(_FOLDERS)}[1 + o_orderkey % 8] AS folder, {list(_FILE_NAMES)}[1 + o_custkey % 8] AS name FROM orders),
u AS (SELECT folder || name AS path, string_split(folder, '/') AS parts, name FROM p)
SELECT path, count(*) AS n,
  list_has_any(parts, ['test', 'tests', 'testing', 'unittest', 'unittests', 'integration_tests']) OR (name LIKE 'test\\_%.py' ESCAPE '\\') OR (name LIKE '%\\_test.py' ESCAPE '\\') OR name IN ('conftest.py', 'tests.py') AS gate,
  list_has_any(parts, ['test', 'tests', 'testing', 'unittests', 'unit_tests', 'integration_tests']) OR starts_with(name, 'test_') OR ends_with(name, '_test.py') OR name IN ('conftest.py', 'tests.py') AS footprint,
  list_has_any(list_append(parts, name), ['test', 'tests', 'testing']) OR starts_with(name, 'test_') OR starts_with(parts[1], 'test_') OR ends_with(name, '_test.py') OR ends_with(name, 'conftest.py') AS review
FROM u GROUP BY path, parts, name""")
def test_paths(spark, sf_dir):
    """Each order stands for a file; the three rules disagree on some."""
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % 8 + 1).cast("int"))
    path = F.concat(pick(_FOLDERS, "o_orderkey"), pick(_FILE_NAMES, "o_custkey"))
    counted = t(spark, sf_dir, "orders").groupBy(path.alias("path")).agg(F.count("*").alias("n"))
    return counted.withColumns({rule: names.is_test_path(F.col("path"), rule) for rule in names.TEST_PATHS})


_GUARDED = [
    ("a.py", "try:\n    import x\nexcept ImportError:\n    x = None\nimport y\n"),
    ("b.py", "try:\n    import tomllib\nexcept ModuleNotFoundError:\n    import x.toml as tomllib\n"),
    ("c.py", "try:\n    import z\nexcept ImportError as e:\n    raise SystemExit(1)\n"),
    ("d.py", "def broken(:\n"),
]


@query("SELECT * FROM (VALUES ('x', 2, 'optional by design'), ('y', 1, 'required'), ('tomllib', 1, 'optional by design'), ('z', 1, 'required'), ('w', 0, 'never imported')) v(dep, sites, verdict)")
def import_guards(spark, sf_dir):
    sites = traces.import_sites(spark.createDataFrame(_GUARDED, "path string, text string")).select(code.root_name(F.col("imported")).alias("dep"), "kind")
    asked = spark.createDataFrame([(d,) for d in ("x", "y", "z", "w", "tomllib")], "dep string")
    return traces.guard_verdict(asked.join(sites, "dep", "left"), "dep", "kind").withColumn("sites", F.col("sites").cast("int"))


# Censuses, windows, sampling, joins.


@query("""SELECT coalesce(quality = 1, false) AS ci, n_chars > 1000 AS imports, coalesce(toxic = 1, false) AS collects, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def oracle_truth_table(spark, sf_dir):
    d = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return census.truth_table(d.select((F.col("quality") == 1).alias("ci"), (F.col("n_chars") > 1000).alias("imports"), (F.col("toxic") == 1).alias("collects")), ["ci", "imports", "collects"])


@query("""WITH n AS (SELECT l_linenumber AS budget, count(*) FILTER (l_returnflag = 'R') AS caught, count(*) FILTER (l_returnflag = 'A') AS agrees FROM lineitem GROUP BY 1)
SELECT budget, caught, agrees, caught + agrees AS verdicts, CASE WHEN caught + agrees > 0 THEN caught / (caught + agrees)::DOUBLE ELSE 0 END AS catch_rate FROM n""")
def budget_sweep(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("budget"), F.when(F.col("l_returnflag") == "R", "caught").when(F.col("l_returnflag") == "A", "agrees").alias("o"))
    return census.budget_sweep(rows, "budget", "o")


@query("""WITH p AS (SELECT o_orderpriority AS g, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT o_orderpriority AS g, count(*) + (o_orderpriority = '1-URGENT')::INT AS total FROM orders GROUP BY 1)
SELECT g, sum(n)::BIGINT AS parts, total, sum(n) = total AS holds FROM p JOIN s USING (g) GROUP BY g, total""")
def ledger_reconciliation(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("g", F.col("o_orderpriority"))
    stated = o.groupBy("g").agg((F.count("*") + F.max((F.col("g") == "1-URGENT").cast("int"))).alias("total"))
    return census.reconcile(o.groupBy("g", "o_orderstatus").agg(F.count("*").alias("n")), "g", "o_orderstatus", "n", stated, "total")


@query("""WITH a AS (SELECT l_suppkey AS k, count(*) > 60 AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) > 60 AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT count(*) AS common, avg((a.f = b.f)::INT) AS agreement FROM a JOIN b USING (k)""")
def node_agreement(spark, sf_dir):
    side = lambda flag: t(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg((F.count("*") > 60).alias("f"))
    return census.node_agreement(side("R"), side("A"), "k", "f")


@query("""WITH n AS (SELECT p_partkey, count(l_orderkey) FILTER (l_returnflag = 'R') AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'indirect' WHEN n <= 2 THEN 'narrow' WHEN n <= 4 THEN 'medium' ELSE 'wide' END AS tier, count(*) AS n FROM n GROUP BY 1""")
def difficulty_tiers(spark, sf_dir):
    n = t(spark, sf_dir, "part").join(t(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    return n.groupBy(census.difficulty(F.col("n")).alias("tier")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM n) WHERE r = 1""")
def most_frequent_with_ties(spark, sf_dir):
    n = t(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return census.argmax(n, "c_nationkey", "c_mktsegment", "n")


@query("""WITH s AS (SELECT 0 AS one, l_linenumber AS step, count(*) AS accepted FROM lineitem GROUP BY 2) SELECT step, accepted, lag(accepted) OVER (ORDER BY step) - accepted AS lost FROM s""")
def step_losses(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.count("*").alias("accepted")).withColumn("one", F.lit(0))
    return census.step_difference(s, "one", "step", "accepted").select("step", "accepted", "lost")


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS hit, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS c, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, min(CASE WHEN event_id = f THEN n END) OVER (PARTITION BY user_id) AS pos FROM e) SELECT user_id, event_id FROM h WHERE n BETWEEN coalesce(pos - 4, c - 3) AND coalesce(pos, c)""")
def context_before_hit(spark, sf_dir):
    rows = text.context_window(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "purchase", 4)
    return rows.select("user_id", "event_id")


@query("""SELECT text_key, doc_id FROM (SELECT sha1(text) AS text_key, doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def first_occurrences(spark, sf_dir):
    return census.first_occurrences(t(spark, sf_dir, "documents").select(F.sha1("text").alias("text_key"), "doc_id"), ["text_key"], ["doc_id"])


@query("""SELECT l_partkey, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20""")
def top_frequent(spark, sf_dir):
    """A top-k report: most frequent first, ties by key."""
    return t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q")).orderBy(F.desc("n"), "l_partkey").limit(20)


_SAMPLE_SQL = """h AS (SELECT c_custkey, c_mktsegment, md5('7|' || c_custkey) AS h FROM customer), q AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS n FROM h),
o AS (SELECT c_custkey, c_mktsegment FROM q WHERE (c_mktsegment = 'BUILDING' AND n <= 5) OR (c_mktsegment = 'MACHINERY' AND n <= 3)), r AS (SELECT c_custkey, c_mktsegment FROM h WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') ORDER BY h, c_custkey LIMIT 22)"""


@query(f"WITH {_SAMPLE_SQL} SELECT * FROM o UNION ALL SELECT * FROM r")
def quota_sample(spark, sf_dir):
    """A sampling operator: thirty rows."""
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return census.quota_sample(rows, "c_mktsegment", "c_custkey", {"BUILDING": 5, "MACHINERY": 3}, 30, 7)


@query("""WITH n AS (SELECT count(*) AS n FROM part) SELECT i::INT AS shard, least(n, i * ((n + 6) // 7))::BIGINT AS low, least(n, (i + 1) * ((n + 6) // 7))::BIGINT AS high FROM n, range(7) t(i)""")
def shard_ranges(spark, sf_dir):
    n = t(spark, sf_dir, "part").agg(F.count("*").alias("n")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(6))))
    low, high = census.shards(F.col("n"), 7, F.col("shard"))
    return n.select("shard", low.alias("low"), high.alias("high"))


@query()
def greedy_draw(spark, sf_dir):
    """A sampling operator: pairs of nation and segment, by order priority; held against brute force."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pool = o.select(F.col("o_orderpriority").alias("tier"), F.concat(F.lit("r"), "c_nationkey").alias("repo"), "c_mktsegment")
    quotas = pool.select("tier").distinct().withColumn("quota", F.lit(6))
    return draws.greedy_draw(pool, quotas, "tier", "repo", "c_mktsegment", 2, 10, 30)


@query("""WITH i AS (SELECT n_name || '__all__' || r_name AS id, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_name AS a, r_name AS b, i.id FROM nation CROSS JOIN region LEFT JOIN i ON i.a = n_name AND i.b = r_name""")
def affix_join(spark, sf_dir):
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    ids = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("__", "n_name", F.lit("all"), "r_name").alias("id"))
    every = n.select(F.col("n_name").alias("a")).withColumn("b", F.explode(F.array(*[F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])))
    return census.affix_join(every.join(r.select(F.col("r_name").alias("b")), "b", "left_semi"), ids, "a", "b", "id")


@query(r"""WITH v AS (SELECT * FROM (VALUES ('cc-by', 'cc by'), ('cc-by', 'cc-by'), ('apache', 'apache license'), ('gnu', 'gnu')) v(dep, variant))
SELECT DISTINCT dep, doc_id FROM v JOIN documents ON regexp_matches(' ' || regexp_replace(lower(text), '[^a-z0-9_-]+', ' ', 'g') || ' ', '[^a-z0-9]' || variant || '[^a-z0-9]')""")
def config_mentions(spark, sf_dir):
    v = spark.createDataFrame([("cc-by", "cc by"), ("cc-by", "cc-by"), ("apache", "apache license"), ("gnu", "gnu")], "dep string, variant string")
    return census.mention_join(v, t(spark, sf_dir, "documents"), "dep", "variant", "doc_id", "text")


@query("""SELECT s.k AS name, p.p_partkey FROM (VALUES ('building', 'brand#11'), ('building', 'brand#12'), ('other', NULL)) s(k, alias) JOIN part p ON lower(p.p_brand) = s.alias""")
def alias_join(spark, sf_dir):
    rows = spark.createDataFrame([("building",), ("other",)], "name string")
    aliases = spark.createDataFrame([("building", ["brand#11", "brand#12"])], "name string, names array<string>")
    table = t(spark, sf_dir, "part").select(F.lower("p_brand").alias("alias"), "p_partkey")
    return census.alias_join(rows, aliases, "name", "names", table, "alias").select("name", "p_partkey")


@query("""WITH a AS (SELECT user_id, event_id AS at FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, event_id FROM events WHERE event_type IS DISTINCT FROM 'purchase'),
l AS (SELECT p.*, a.at AS lo FROM p ASOF LEFT JOIN a ON a.user_id = p.user_id AND p.event_id >= a.at), h AS (SELECT l.*, a.at AS hi FROM l ASOF LEFT JOIN a ON a.user_id = l.user_id AND l.event_id <= a.at)
SELECT user_id, event_id, CASE WHEN lo IS NULL OR hi - event_id < event_id - lo THEN hi ELSE lo END AS anchor FROM h""")
def nearest_anchor(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    anchors = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("anchor"))
    return census.nearest_anchor(e.where(~F.col("event_type").eqNullSafe("purchase")).select("user_id", "event_id"), anchors, "user_id", "event_id", "anchor")


@query("""WITH f AS (SELECT conv_id, bool_or(contains(text, 'a')) FILTER (turn < 5) AS x FROM conversations GROUP BY 1), n AS (SELECT conv_id, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, CASE WHEN bool_or(contains(text, 'tool')) THEN 'recorder' WHEN bool_or(contains(text, 'the')) THEN 'blocker' ELSE 'none' END AS kind FROM n WHERE n <= 5 GROUP BY 1""")
def inferred_kinds(spark, sf_dir):
    return text.inferred_kind(t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", [("recorder", "tool"), ("blocker", "the")])


@query("""SELECT CASE WHEN contains(text, 'Licensed under') THEN 'marker: license' WHEN contains(text, 'token = ') THEN 'marker: secret' END AS class, count(*) AS n FROM documents WHERE contains(text, 'Licensed under') OR contains(text, 'token = ') GROUP BY 1""")
def leakage_scan(spark, sf_dir):
    """Documents that hold one of our markers, by the first one."""
    return text_classes(t(spark, sf_dir, "documents"), "text", [("marker: license", "Licensed under"), ("marker: secret", "token = ")])


def text_classes(rows: DataFrame, column: str, markers: list[tuple[str, str]]) -> DataFrame:
    """(class, n): rows by the first marker that they hold; rows without any are left out."""
    label = F.coalesce(*[F.when(F.col(column).contains(m), F.lit(name)) for name, m in markers])
    return rows.select(label.alias("class")).where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (VALUES ('r1', 'some-lib', 'a/requirements-dev.txt'), ('r2', 'x', 'tox.ini')) v(repo, dep, path)""")
def second_install_source(spark, sf_dir):
    rows = spark.createDataFrame([("r1", "b/requirements.txt", "# some-lib\nsome_lib==1\n"), ("r1", "a/requirements-dev.txt", "Some_Lib\n"), ("r2", "tox.ini", "[x]\n  x>=1\n"), ("r2", "setup.cfg", "xx\n")], "repo string, path string, text string")
    wanted = spark.createDataFrame([("r1", "some-lib"), ("r2", "x"), ("r2", "none")], "repo string, dep string")
    return manifests.declares_elsewhere(rows, wanted, "repo", "dep")


@query("""SELECT o_custkey, bool_or(o_orderstatus = 'O') AS caught, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'rejected' WHEN bool_or(o_orderstatus = 'F') THEN 'accepted' ELSE 'no verdict' END AS verdict,
max(o_orderdate)::VARCHAR AS last_day, list_aggregate(list_sort(list(o_orderkey)), 'string_agg', ',') AS keys FROM orders GROUP BY 1""")
def rollup_by_unit(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("caught"), F.bool_or(F.col("o_orderstatus") == "F").alias("agrees"), F.max("o_orderdate").cast("string").alias("last_day"), F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    verdict = F.when(F.col("caught"), "rejected").when(F.col("agrees"), "accepted").otherwise("no verdict")
    return o.select("o_custkey", "caught", verdict.alias("verdict"), "last_day", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("keys"))


@query("""SELECT nth::INT AS nth, line FROM (VALUES (0, '| segment | n |'), (1, '|-|-|')) h(nth, line) UNION ALL
SELECT row_number() OVER (ORDER BY c_mktsegment) + 1, '| ' || c_mktsegment || ' | ' || count(*) || ' |' FROM customer GROUP BY c_mktsegment""")
def markdown_report(spark, sf_dir):
    n = t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return writers.markdown_lines(n, ["segment", "n"], ["segment"])


@query("""SELECT row_number() OVER (ORDER BY c_mktsegment)::INT AS nth, rpad(c_mktsegment, 12, ' ') || ' ' || lpad(count(*)::VARCHAR, 8, ' ') AS line FROM customer GROUP BY c_mktsegment""")
def fixed_width_report(spark, sf_dir):
    n = t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return writers.fixed_width_lines(n, {"segment": 12, "n": 8}, ["segment"])


@query("""WITH p AS (SELECT p_type || '/' || p_brand || '/' || p_partkey AS path FROM part), d AS (SELECT path, 2 AS depth, split_part(path, '/', 3) AS name FROM p UNION SELECT split_part(path, '/', 1), 0, split_part(path, '/', 1) FROM p
UNION SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 1, split_part(path, '/', 2) FROM p) SELECT path, repeat('  ', depth) || name AS line FROM d""")
def tree_rendering(spark, sf_dir):
    return manifests.tree_lines(t(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand", "p_partkey").alias("path")))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_orderkey, pos::BIGINT AS pos FROM r WHERE pos >= 100 AND pos < 130""")
def index_slice(spark, sf_dir):
    """Rows 100 to 129 by key: a slice is what is asked for."""
    first = t(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(130)  # a distributed top-k
    return first.select("o_orderkey", (F.row_number().over(Window.orderBy("o_orderkey")) - 1).cast("long").alias("pos")).where("pos >= 100")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS passed, left(o_orderpriority || ' of ' || o_orderkey, 12) AS evidence, o_orderkey || '.ts' AS file, strftime(o_orderdate, '%Y-%m') AS month FROM orders""")
def row_projections(spark, sf_dir):
    """First value that isn't null as a Boolean, evidence cut to a length, suffix by language, ISO dates, a template."""
    status = F.when(F.col("o_orderstatus") == "F", "Passed").when(F.col("o_orderstatus") == "O", "no")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", code.first_boolean(F.lit(None).cast("string"), status).alias("passed"), F.left(F.format_string("%s of %d", "o_orderpriority", "o_orderkey"), F.lit(12)).alias("evidence"),
        F.concat("o_orderkey", manifests.suffix_of(F.lit("TypeScript"))).alias("file"), F.date_format(F.to_timestamp(F.col("o_orderdate").cast("string")), "yyyy-MM").alias("month"),
    )


@query("""SELECT user_id, bool_or(event_type = 'purchase') AS any_purchase, bool_and(event_type <> 'purchase') AS no_purchase, count(*) FILTER (props IS NOT NULL) AS present FROM events GROUP BY 1""")
def quantified_predicates(spark, sf_dir):
    rows = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.count_if(F.try_parse_json("props").isNotNull()).alias("present"))
    return rows.select("user_id", F.exists("kinds", lambda k: k == "purchase").alias("any_purchase"), F.forall("kinds", lambda k: k != "purchase").alias("no_purchase"), "present")


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3 passed' WHEN 1 THEN '1 failed, 2 passed' WHEN 2 THEN 'no tests ran' ELSE 'collecting' END AS s FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 3 THEN NULL ELSE 'fail' END AS run, CASE WHEN doc_id % 4 = 0 THEN 'pass' ELSE 'fail' END AS ci, 'line ' || s AS stripped FROM r""")
def log_verdicts(spark, sf_dir):
    """Logs made from documents: prefixes of a job on each line, a summary near the end."""
    word = F.when(F.col("doc_id") % 4 == 0, "3 passed").when(F.col("doc_id") % 4 == 1, "1 failed, 2 passed").when(F.col("doc_id") % 4 == 2, "no tests ran").otherwise("collecting")
    out = F.concat(F.lit("start\n"), word, F.lit("\n\nbye\n"))
    log = F.concat(F.lit("⭐ Run Main\n🏁  Job "), F.when(F.col("doc_id") % 4 == 0, "succeeded").otherwise("failed"))
    return t(spark, sf_dir, "documents").select("doc_id", code.run_verdict(out, F.lit("")).alias("run"), code.ci_verdict(log, F.lit(0)).alias("ci"), code.strip_log_prefix(F.concat(F.lit("[ci/x] | line "), word)).alias("stripped"))


__all__ = ["QUERIES", "code_copy_scores"]
