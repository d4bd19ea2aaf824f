"""Queries over program texts, recorded values and notes that are made from the tables' rows: mutants, literals, renamed
copies, module graphs, brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals, scan
from ..functions.code import root_name
from ..operators import modules, mutants, renames, sheets, traces
from .catalogue import query, t


def _functions(spark, sf_dir) -> DataFrame:
    """A Python function for each part: bounds and what is returned depend on the row."""
    head = F.concat(F.lit("def f"), "p_partkey", F.lit("(x, y):  # "), "p_brand", F.lit("\n    if x < "), "p_size", F.lit(" and not y:\n"))
    kind = F.col("p_size") % 3
    value = F.when(kind == 0, F.concat(F.lit("[len(x), "), "p_size", F.lit("]"))).when(kind == 1, "0").otherwise("None")
    # parsing costs far more than moving such short rows, and a small table is one partition
    return t(spark, sf_dir, "part").repartition("p_partkey").select("p_partkey", "p_size", F.concat(head, F.lit("        return "), value, F.lit("\n    return y in x\n")).alias("source"))


_MUTANTS = """s AS (SELECT p_partkey, p_size % 3 AS kind FROM part),
m AS (SELECT p_partkey, unnest(['comparison', 'comparison', 'boundary+1', 'boundary-1', 'branch', 'constant return', 'negation dropped', 'and/or swapped']) AS operator FROM s
UNION ALL SELECT p_partkey, unnest(['boundary+1', 'boundary-1', 'constant return', 'call dropped', 'container emptied']) FROM s WHERE kind = 0
UNION ALL SELECT p_partkey, unnest(['boundary+1', 'boundary-1']) FROM s WHERE kind = 1)"""


@query(f"WITH {_MUTANTS} SELECT operator, count(*) AS n, count(DISTINCT p_partkey) AS sources FROM m GROUP BY 1")
def mutant_census(spark, sf_dir):
    """The mutants of all functions by operator."""
    found = mutants.mutants(_functions(spark, sf_dir), "source")
    return found.groupBy("operator").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("sources"))


@query(f"""WITH {_MUTANTS}, v AS (SELECT p_partkey, CASE WHEN operator IN ('branch', 'call dropped') THEN NULL ELSE p_partkey % 4 = 0 OR operator = 'comparison' AND p_partkey % 4 = 1 END AS ok FROM m),
n AS (SELECT p_partkey, count(*) AS mutants, count(*) FILTER (NOT ok) AS killed, count(*) FILTER (ok) AS survived FROM v GROUP BY 1)
SELECT p_partkey, coalesce(mutants, 0) AS mutants, coalesce(killed, 0) AS killed, coalesce(survived, 0) AS survived,
CASE WHEN p_partkey % 5 = 0 THEN 'unverified' WHEN survived > 0 AND killed = 0 THEN 'fail' ELSE 'pass' END AS status FROM part LEFT JOIN n USING (p_partkey)""")
def mutant_scores(spark, sf_dir):
    """Which mutants the tests notice is a rule over keys and operators; each fifth function fails its own tests."""
    source = _functions(spark, sf_dir)
    found = mutants.mutants(source, "source")
    ok = F.when(~F.col("operator").isin("branch", "call dropped"), (F.col("p_partkey") % 4 == 0) | ((F.col("operator") == "comparison") & (F.col("p_partkey") % 4 == 1)))
    return mutants.killed(found.select("p_partkey", ok.alias("ok")), source, ["p_partkey"], F.col("ok"), F.col("p_partkey") % 5 != 0)


def _repositories(spark, sf_dir) -> DataFrame:
    """A repository for each part, with a file for each of its lines: modules that import a package and the next module, and
    for the lines 3 and 6 tests that import the module two lines before."""
    rows = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("repo"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("s"))
    dep, n = (F.col("s") % 4).cast("string"), F.col("n")
    test = n.isin(3, 6)
    path = F.concat(F.when(test, "tests/test_m").otherwise("src/pkg/m"), n, F.lit(".py"))
    module = F.concat(F.lit("import os, dep"), dep, F.lit(".sub as d\nfrom . import m"), n + 1, F.lit("\nd.run(d.x)\n"))
    tested = F.concat(F.lit("import dep"), dep, F.lit("\nfrom pkg.m"), n - 2, F.lit(" import f\nf()\n"))
    files = rows.select("repo", path.alias("path"), F.when(test, tested).otherwise(module).alias("text"))
    return files.unionByName(rows.select("repo").distinct().select("repo", F.lit("src/pkg/__init__.py").alias("path"), F.lit("").alias("text")))


_REPOSITORIES = """f AS (SELECT l_partkey AS repo, l_linenumber AS n, min(l_suppkey) % 4 AS dep FROM lineitem GROUP BY 1, 2),
h AS (SELECT repo, bool_or(n = 1) AS h1, bool_or(n = 2) AS h2, bool_or(n = 3) AS h3, bool_or(n = 4) AS h4, bool_or(n = 5) AS h5, bool_or(n = 6) AS h6 FROM f GROUP BY 1)"""


@query(f"""WITH {_REPOSITORIES} SELECT repo, 'dep-' || dep AS dep, count(*) FILTER (n NOT IN (3, 6)) AS files, count(*) FILTER (n IN (3, 6)) AS test_files, 2 * count(*) FILTER (n NOT IN (3, 6)) AS uses,
bool_or(n IN (3, 6) OR n = 1 AND h3 OR n = 2 AND h3 AND h1 OR n = 4 AND h6 OR n = 5 AND h6 AND h4) AS reachable FROM f JOIN h USING (repo) GROUP BY repo, dep""")
def repository_footprints(spark, sf_dir):
    aliases = spark.createDataFrame([(f"dep-{i}", f"dep{i}") for i in range(5)], "dep string, alias string")
    return modules.footprints(_repositories(spark, sf_dir), aliases, "dep", "alias")


@query(f"""WITH {_REPOSITORIES} SELECT CASE WHEN n IN (3, 6) THEN 'tests/test_m' ELSE 'src/pkg/m' END || n || '.py' AS src,
CASE WHEN n = 1 AND h2 THEN 'src/pkg/m2.py' WHEN n = 4 AND h5 THEN 'src/pkg/m5.py' WHEN n = 3 AND h1 THEN 'src/pkg/m1.py' WHEN n = 6 AND h4 THEN 'src/pkg/m4.py' END AS dst, count(*) AS n FROM f JOIN h USING (repo) WHERE dst IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT CASE WHEN n IN (3, 6) THEN 'tests/test_m' ELSE 'src/pkg/m' END || n || '.py', 'src/pkg/__init__.py', count(*) FROM f JOIN h USING (repo) WHERE n NOT IN (3, 6) OR n = 3 AND NOT h1 OR n = 6 AND NOT h4 GROUP BY 1""")
def relative_imports(spark, sf_dir):
    """How often a file leads to another, over all repositories."""
    edges, _, _ = modules.module_graph(_repositories(spark, sf_dir))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_size % 7 AS n, p_size % 4 AS d, p_partkey % 11 <> 0 AS closed FROM part)
SELECT p_partkey, CASE WHEN closed THEN 10 + 6 * n + 2 * d ELSE -1 END::BIGINT AS "end" FROM p""")
def bracket_ends(spark, sf_dir):
    """A list for each part: strings with brackets and escapes in them, then nested tuples; each eleventh stays open."""
    many = lambda text, m: F.repeat(F.lit(text), (F.col("p_size") % m).cast("int"))
    text = F.concat(F.lit("deps = [ "), many("'\\']'", 7), many(" ", 7), many("(", 4), many("}", 4), F.when(F.col("p_partkey") % 11 != 0, "] # ]").otherwise('"]"'))
    return t(spark, sf_dir, "part").select("p_partkey", scan.balanced_end(text, F.lit(7)).cast("long").alias("end"))


@query("""SELECT s_suppkey, 'Total' AS name, '{' || s_nationkey || '{,}' || s_suppkey || '}' AS value FROM supplier UNION ALL SELECT s_suppkey, 'Outer', 'a \\newcommand{\\Inner}{b' || s_suppkey || '} {c}' FROM supplier
UNION ALL SELECT s_suppkey, 'Inner', 'b' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, 'Open', NULL FROM supplier WHERE s_suppkey % 3 = 0""")
def macro_values(spark, sf_dir):
    """The macros of a note for each supplier: digit separators in braces, a definition within another, one left open."""
    define = lambda name, *value: F.concat(F.lit(f"\\newcommand{{\\{name}}}{{"), *value)
    total = define("Total", F.lit("{"), "s_nationkey", F.lit("{,}"), "s_suppkey", F.lit("}}\n"))
    outer = define("Outer", F.lit("a "), define("Inner", F.lit("b"), F.col("s_suppkey").cast("string"), F.lit("}")), F.lit(" {c}}\n"))
    note = F.concat(F.lit("% note\n"), total, outer, F.when(F.col("s_suppkey") % 3 == 0, define("Open", F.lit("x {y}\n"))).otherwise(""))
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.explode(scan.macros(note)).alias("m")).select("s_suppkey", "m.name", "m.value")


@query()
def renamed_sources(spark, sf_dir):
    """Documents read as source text, by the digest of their renamed copy; held against a plain renaming."""
    found = renames.renamed(t(spark, sf_dir, "documents"), ["doc_id"], "text")
    return found.select("doc_id", F.length("renamed").cast("long").alias("length"), F.sha1("renamed").alias("digest"))


def _recorded(k: Column) -> Column:
    """A recorded value for each event, of ten forms."""
    n = k.cast("string")
    forms = [
        F.concat(F.lit('{"t":"int","v":'), n, F.lit("}")),
        F.concat(F.lit('{"t":"list","n":2,"items":[{"t":"int","v":'), n, F.lit('},{"t":"str","n":2,"v":"it\'s"}]}')),
        F.concat(F.lit('{"t":"dict","n":1,"items":[[{"t":"str","n":1,"v":"k"},{"t":"tuple","n":1,"items":[{"t":"float","v":"'), n, F.lit('.5"}]}]]}')),
        F.lit('{"t":"bytes","n":2,"v":"hi"}'),
        F.lit('{"t":"NoneType"}'),
        F.lit('{"t":"set","n":0,"items":[]}'),
        F.lit('{"t":"list","n":1,"items":[{"t":"Socket","r":"<s>"}]}'),
        F.lit('{"t":"bool","v":true}'),
        F.lit('{"t":"float","v":"nan"}'),
        n,
    ]
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        out = F.when(k % 10 == i, f).otherwise(out)
    return out


@query(r"""WITH k AS (SELECT (props->>'$.k')::INT AS k FROM events), f AS (SELECT CASE k % 10 WHEN 0 THEN k::VARCHAR WHEN 1 THEN '[' || k || ', ''it\''s'']' WHEN 2 THEN '{''k'': (' || k || '.5,)}' WHEN 3 THEN 'b''\x68\x69''' WHEN 4 THEN 'None' WHEN 5 THEN 'set()' WHEN 7 THEN 'True' WHEN 8 THEN 'float(''nan'')' WHEN 9 THEN k::VARCHAR END AS literal FROM k)
SELECT literal, count(*) AS n FROM f GROUP BY 1""")
def recorded_literals(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    # equal records have one literal, so each different record is read once
    records = t(spark, sf_dir, "events").groupBy(_recorded(k).alias("record")).agg(F.count("*").alias("n"))
    return records.groupBy(literals.literal(F.col("record")).alias("literal")).agg(F.sum("n").alias("n"))


@query("""WITH k AS (SELECT user_id, user_id % 4 AS kind, (props->>'$.k')::INT % 3 AS v FROM events WHERE props->>'$.k' IS NOT NULL), s AS (SELECT user_id, kind, list(DISTINCT v) AS vs FROM k GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events WHERE props->>'$.k' IS NOT NULL)
SELECT user_id, CASE kind WHEN 0 THEN CASE WHEN NOT list_contains(vs, 0) THEN '0' ELSE '-1' END WHEN 1 THEN CASE WHEN NOT list_contains(vs, 0) THEN 'False' WHEN NOT (list_contains(vs, 1) OR list_contains(vs, 2)) THEN 'True' END
WHEN 2 THEN CASE WHEN NOT list_contains(vs, 0) THEN '[]' ELSE '[None]' END END AS literal FROM u JOIN s USING (user_id)""")
def wrong_value_choice(spark, sf_dir):
    """Users' calls return numbers, truths, lists, or values of two types."""
    v = F.get_json_object("props", "$.k").cast("int") % 3
    kind, n = F.col("user_id") % 4, v.cast("string")
    value = (
        F.when(kind == 0, F.concat(F.lit('{"t":"int","v":'), n, F.lit("}"))).when(kind == 1, F.concat(F.lit('{"t":"bool","v":'), (v > 0).cast("string"), F.lit("}")))
        .when(kind == 2, F.when(v == 0, '{"t":"list","n":0,"items":[]}').otherwise('{"t":"list","n":1,"items":[{"t":"int","v":1}]}')).otherwise('{"t":"NoneType"}')
    )
    calls = t(spark, sf_dir, "events").where("get_json_object(props, '$.k') IS NOT NULL").select("user_id", value.alias("value"))
    return literals.wrong_values(calls, "user_id", "value")


@query("""WITH k AS (SELECT user_id, (props->>'$.k')::INT AS k FROM events), c AS (SELECT user_id, k, CASE WHEN k % 2 = 0 THEN k::VARCHAR END AS r FROM k WHERE k IS NOT NULL), u AS (SELECT DISTINCT user_id, (user_id % 100)::VARCHAR AS f FROM events)
SELECT u.user_id, count(k) AS n, count(r) AS comparable, count(*) FILTER (r = f) AS equal, count(r) > 0 AND count(*) FILTER (r = f) = 0 AS convincing FROM u LEFT JOIN c ON c.user_id = u.user_id GROUP BY 1""")
def counterfeit_literals(spark, sf_dir):
    """A fake number for each user against what the calls returned; odd values are live objects."""
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    value = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"t":"int","v":'), "k", F.lit("}"))).otherwise('{"t":"Foo","r":"<f>"}')
    fakes = e.select("user_id", (F.col("user_id") % 100).cast("string").alias("fake")).distinct()
    return literals.held_against(fakes, e.where("k IS NOT NULL").select("user_id", value.alias("value")), "user_id", "fake", "value")


@query(r"""WITH b AS (SELECT doc_id, quality, toxic, regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n\z', '') AS body FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT conv_id, max_by(text, turn) AS said FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1),
x AS (SELECT b.*, array_to_string(list_slice(list_concat(['diff --git a/src/m' || doc_id || '.py b/src/m' || doc_id || '.py', 'new file mode 100644', '--- /dev/null', '+++ b/src/m' || doc_id || '.py', '@@ -0,0 +1 @@'], list_transform(string_split(body, chr(10)), lambda l: '+' || l)), 1, 20), chr(10)) AS excerpt FROM b)
SELECT doc_id, sha1('## ' || doc_id || chr(10) || chr(10) || 'quality: ' || coalesce(quality::VARCHAR, '-') || ' | toxic: ' || coalesce(toxic::VARCHAR, '-') || chr(10) || chr(10) || 'Said last: ' || coalesce(left(said, 40), '') || chr(10) || chr(10) || 'Verdict: ____________' || chr(10) || chr(10)
|| '```diff' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '(no changes outside of manifests)' ELSE excerpt END || chr(10) || '```') AS digest FROM x LEFT JOIN s ON s.conv_id = doc_id""")
def review_sheets(spark, sf_dir):
    """A sheet for each document: its labels, what the agent of the same number said last, and its patch, without the
    manifest; each fifth patch changes the manifest only."""
    d = t(spark, sf_dir, "documents")
    body = F.regexp_replace(F.regexp_replace("text", r"\r\n|\r", "\n"), r"\n\z", "")
    name = F.concat(F.lit("src/m"), "doc_id", F.lit(".py"))
    manifest = F.lit("diff --git a/pyproject.toml b/pyproject.toml\n--- a/pyproject.toml\n+++ b/pyproject.toml\n@@ -1 +0,0 @@\n-x\n")
    module = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1 @@\n+"), F.replace(body, F.lit("\n"), F.lit("\n+")), F.lit("\n"))
    patches = d.select("doc_id", F.concat(manifest, F.when(F.col("doc_id") % 5 == 0, "").otherwise(module)).alias("patch"))
    attempts = d.select("doc_id").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    found = sheets.review_sheet(attempts, ["quality", "toxic"], patches, t(spark, sf_dir, "conversations"), "doc_id", "patch", "conv_id", "turn", "role", "text", 20, 40)
    return found.select("doc_id", F.sha1("sheet").alias("digest"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS k, 'dep' || p_size % 10 AS dep FROM part), n AS (SELECT dep, count(*) AS sites, bool_and(k IN (0, 1)) AS soft FROM p GROUP BY 1) SELECT dep, sites, CASE WHEN soft THEN 'optional by design' ELSE 'required' END AS verdict FROM n""")
def guarded_imports(spark, sf_dir):
    """A module for each part imports a package: with a way out, as a way out, with an error of its own, or plainly."""
    dep, k = F.concat(F.lit("dep"), F.col("p_size") % 10), F.col("p_size") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("try:\n    import "), dep, F.lit(".x\nexcept ImportError:\n    pass\n"))).when(k == 1, F.concat(F.lit("try:\n    import json\nexcept ModuleNotFoundError:\n    import "), dep, F.lit(" as json\n")))
        .when(k == 2, F.concat(F.lit("try:\n    import "), dep, F.lit("\nexcept ImportError as e:\n    raise SystemExit(1)\n"))).otherwise(F.concat(F.lit("from "), dep, F.lit(" import y\n")))
    )
    files = t(spark, sf_dir, "part").repartition("p_partkey").select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("path"), text.alias("text"))
    sites = traces.import_sites(files).select(root_name(F.col("imported")).alias("dep"), "kind").where("dep <> 'json'")
    return traces.guard_verdict(sites, "dep", "kind")
