"""Gates over submissions: tri-state verdicts with a reason and evidence.

A gate's status is 'pass', 'fail' or 'unverified' (it can't speak); a null status means that the gate isn't there. Null
inputs make a gate unverified unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.names import lines, norm
from .graph import closures, cut, parts, to_all
from .text import diff_lines, path_of

# What a test file, a test, an assertion, a skip, a parametrisation and an empty body look like; the files,
# tables and sections that steer a test run; packages that only build or test; gates that rest on a constraint which a task
# doesn't state.
TEST_PATH = names.TEST_PATHS["gate"]
TEST_DEF = r"^\s*(async\s+)?def\s+(test_[A-Za-z0-9_]*|[A-Za-z0-9_]*_test)\s*\("
ASSERTION = r"\bassert\b|\bself\.assert[A-Za-z]*\s*\(|\bpytest\.raises\b|\bself\.fail\s*\(|\bnp\.testing\.assert"
SKIP = r"@(pytest\.mark\.)?(skip|skipif|xfail)\b|\bpytest\.skip\s*\(|\bunittest\.skip\b|\bself\.skipTest\s*\(|\braise\s+SkipTest\b"
PARAMETRIZE = r"@(pytest\.mark\.)?parametrize"
TRIVIAL = r"^\s*(pass|\.\.\.|return(\s+None)?)\s*$"
RUNNER_PATH = r"(^|/)\.github/workflows/[^/]+\.ya?ml$|(^|/)(pytest\.ini|\.pytest\.ini|tox\.ini|noxfile\.py)$"
RUNNER_SECTIONS = {"pyproject.toml": r"^\s*\[\s*tool\.(pytest|tox|nox)(\.|\s*\])", "setup.cfg": r"^\s*\[\s*(tool:pytest|pytest|tox:[^\]]*)\s*\]"}
SECTION = r"^\s*\[[^\]]+\]\s*$"
COLLECTION_HOOK = r"^\s*((async\s+)?def\s+pytest_(collection_modifyitems|ignore_collect|collect_file|collect_directory|pycollect_makeitem|runtest_setup|runtest_call|deselected|runtest_makereport|sessionstart)\b|collect_ignore(_glob)?\s*=)"
BUILD_TIME = ("pip", "setuptools", "wheel", "pytest", "tox", "nox", "build", "setuptools_scm", "hatchling", "flit_core", "poetry_core", "pdm_backend")
UNSTATED = ("G3", "G7", "G8")


def declaration_gate(submissions: DataFrame, key: str, before: str, after: str, target: str) -> DataFrame:
    """G1 (key, status, reason): the declared names after are those before without the target; arrays of names."""
    normed = lambda c: F.array_distinct(F.transform(c, norm))
    b, a, t = normed(before), normed(after), norm(F.col(target))
    gone = ~F.array_contains(a, t)
    exact = gone & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 1) & F.array_contains(b, t)
    reason = F.when(t.isNull(), "no target is named").when(F.col(after).isNull() | F.col(before).isNull(), "the manifest could not be read").when(~gone, "still declared").when(exact, "removed").otherwise("other declarations changed too")
    status = F.when(t.isNull() | F.col(after).isNull() | F.col(before).isNull(), "unverified").when(exact, "pass").otherwise("fail")
    return submissions.select(key, status.alias("status"), reason.alias("reason"))


def tests_gate(verdict: Column) -> Column:
    """G2: the CI verdict."""
    return F.when(verdict == "pass", "pass").when(verdict.isNotNull(), "fail").otherwise("unverified")


def copy_verdict(files: DataFrame, key: str, target: str, least_tokens: int = 60, limit: float = 0.6) -> DataFrame:
    """G3 (key, status, reason, copies) over files(key, target, path, change, tokens, containment); path is null for a
    submission without Python changes, containment where the library's source is unknown. Small files aren't scored."""
    root = norm(F.regexp_replace(F.split_part("path", F.lit("/"), F.lit(1)), r"\.py$", ""))
    name = norm(F.col(target))
    shadows = F.coalesce((F.col("change") == "added") & ((root == name) | (root == F.replace(name, F.lit("_"), F.lit("")))), F.lit(False))
    copy = F.coalesce((F.col("tokens") >= least_tokens) & (F.col("containment") >= limit), F.lit(False))
    unknown = F.col("path").isNotNull() & F.col("containment").isNull()
    n = files.groupBy(key).agg(F.count("path").alias("files"), F.bool_or(shadows).alias("shadow"), F.bool_or(unknown).alias("unknown"), F.count_if(copy).alias("copies"))
    status = F.when(F.col("files") == 0, "pass").when(F.col("shadow"), "fail").when(F.col("unknown"), "unverified").when(F.col("copies") > 0, "fail").otherwise("pass")
    reason = F.when(F.col("files") == 0, "no Python file changed").when(F.col("shadow"), "a new module has the package's name").when(F.col("unknown"), "the library's source is unknown").when(F.col("copies") > 0, "copied files").otherwise("no copied file")
    return n.select(key, status.alias("status"), reason.alias("reason"), "copies")


def mutation_gate(functions: DataFrame, key: str, outcome: str) -> DataFrame:
    """G4c (key, killed, pseudo, fraction, status): fails only if every scored function is pseudo-tested; passes with none."""
    n = functions.groupBy(key).agg(F.count_if(F.col(outcome) == "killed").alias("killed"), F.count_if(F.col(outcome) == "pseudo-tested").alias("pseudo"))
    scored = F.col("killed") + F.col("pseudo")
    return n.select(key, "killed", "pseudo", F.try_divide(F.col("pseudo"), scored).alias("fraction"), F.when((scored > 0) & (F.col("pseudo") == scored), "fail").otherwise("pass").alias("status"))


def behaviour_gate(pairs: DataFrame, key: str, level: str, equal: str) -> DataFrame:
    """G4a (key, status, decided_at, compared, missing) over paired calls (key, level, equal), where equal is null for a call
    that one side lacks. Usage calls decide if any is comparable, else boundary calls; without either it can't speak."""
    known = F.col(equal).isNotNull()
    n = pairs.groupBy(key).agg(
        *[F.count_if(known & (F.col(level) == x)).alias(f"n_{x}") for x in ("usage", "boundary")],
        *[F.count_if(~F.col(equal) & (F.col(level) == x)).alias(f"bad_{x}") for x in ("usage", "boundary")],
        F.count_if(~known).alias("missing"),
    )
    at = F.when(F.col("n_usage") > 0, "usage").when(F.col("n_boundary") > 0, "boundary")
    bad = F.when(at == "usage", F.col("bad_usage")).when(at == "boundary", F.col("bad_boundary"))
    status = F.when(at.isNull(), "unverified").when(bad > 0, "fail").otherwise("pass")
    return n.select(key, status.alias("status"), at.alias("decided_at"), (F.col("n_usage") + F.col("n_boundary")).alias("compared"), "missing")


def phantom_gate(logs: DataFrame, key: str, log: str, pattern: Column) -> DataFrame:
    """G5 (key, status): fails where the log shows the package installed all the same; unverified without a log."""
    text = F.col(log)
    return logs.select(key, F.when(text.isNull() | (F.trim(text) == ""), "unverified").when(F.regexp_like(text, pattern), "fail").otherwise("pass").alias("status"))


def named_package(line: Column, package: Column) -> Column:
    """Does a line name the package as a whole, with hyphens, underscores and dots alike? False for a null package."""
    name = F.regexp_replace(F.regexp_replace(F.lower(package), r"([^a-z0-9_.-])", r"\\$1"), "[-_.]", "[-_.]")
    return F.coalesce(F.regexp_like(F.lower(line), F.concat(F.lit("(?<![a-z0-9])"), name, F.lit("(?![a-z0-9])"))), F.lit(False))


def _start_sections(hunks: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """(key, path, hunk, start): the section of the unchanged file in which a hunk of hunks(key, path, hunk, old_start, anchor)
    begins. The place is the line equal to the hunk's first old line that is nearest to where its header says (ties: the
    upper one), or else where its header says; the section is that of the last header up to there, an as-of join."""
    numbered = originals.select(key, "path", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    size = numbered.groupBy(key, "path").agg(F.max("at").alias("last"))
    want = F.coalesce("old_start", F.lit(1)) - 1
    near = hunks.join(numbered.withColumnRenamed("line", "anchor"), [key, "path", "anchor"]).groupBy(key, "path", "hunk").agg(F.min_by("at", F.struct(F.abs(F.col("at") - want), "at")).alias("near"))
    placed = hunks.join(size, [key, "path"]).join(near, [key, "path", "hunk"], "left")
    at = F.coalesce("near", F.least(F.col("old_start") - 1, "last"))
    points = placed.select(key, "path", at.cast("int").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("header"), "hunk").where("at IS NOT NULL")
    headers = numbered.where(F.col("line").rlike(SECTION)).select(key, "path", "at", F.lit(0).alias("kind"), F.trim("line").alias("header"), F.lit(None).cast("int").alias("hunk"))
    so_far = Window.partitionBy(key, "path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return points.unionByName(headers).withColumn("start", F.last("header", ignorenulls=True).over(so_far)).where("kind = 1").select(key, "path", "hunk", "start")


def oracle_gate(patches: DataFrame, key: str, text: str, target: str | None = None, originals: DataFrame | None = None, injected: tuple[str, str] | None = None) -> DataFrame:
    """G7 (key, status, signals, reason, findings, modified, added): do edits of test files or of the runner's configuration
    weaken the tests? findings are (path, signal, detail) with up to three lines of detail; modified and added are the test
    files. New test files are no edits.

    Files that only steer test runs count whole; pyproject.toml and setup.cfg count where a hunk is in a section of a
    runner. The section goes from header to header through a hunk; before the first one it is that of the unchanged file, if
    originals(key, path, text) has it. A removed line that names the target package as a whole is the task itself, not an
    edit. Lines between the marks `injected` (begin, end) that a harness adds to test files don't count.

    A null patch is unverified; a null target exempts nothing."""
    rows = diff_lines(patches.select(key, text), key, text).where(F.col("new").isNotNull()).withColumn("path", path_of())
    line = F.col("line")
    kind = F.when(line.startswith("+"), "add").when(line.startswith("-"), "del").otherwise("ctx")
    file = ["__path", "__new_file", "__deleted_file"]
    body = rows.select(key, F.col("path").alias("__path"), "hunk", "line_no", F.when(F.col("body"), kind).alias("kind"), F.when(F.col("body"), F.substring(line, 2, 1 << 30)).otherwise(line).alias("line"), (F.col("old") == "/dev/null").alias("__new_file"), (F.col("new") == "/dev/null").alias("__deleted_file"))
    package = patches.select(key, (norm(F.col(target)) if target else F.lit(None).cast("string")).alias("__target"))
    body = body.join(package, key)
    base, trimmed, content = F.element_at(F.split("__path", "/"), -1), F.trim("line"), F.col("line")
    if injected:
        order = Window.partitionBy(key, *file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        mark = F.when(F.col("kind") == "add", F.when(content.contains(injected[0]), 1).when(content.contains(injected[1]), 2))
        body = body.withColumn("__mark", F.last(mark, ignorenulls=True).over(order)).withColumn("__own", (F.col("kind") != "add") | (F.coalesce("__mark", F.lit(2)) == 2) & ~content.contains(injected[1]))
    else:
        body = body.withColumn("__own", F.lit(True))

    sectioned = base.isin(*RUNNER_SECTIONS)
    if originals is not None:
        begins = F.regexp_extract("line", r"^@@ -(\d+)", 1)
        hunks = body.where(sectioned).groupBy(key, F.col("__path").alias("path"), "hunk").agg(F.max(F.when(F.col("kind").isNull() & (F.col("line_no") == F.col("hunk")), F.nullif(begins, F.lit("")).cast("int"))).alias("old_start"), F.min_by("line", F.when(F.col("kind") != "add", F.col("line_no"))).alias("anchor"))
        start = _start_sections(hunks, originals, key).withColumnsRenamed({"path": "__path"})
        body = body.join(start, [key, "__path", "hunk"], "left")
    else:
        body = body.withColumn("start", F.lit(None).cast("string"))
    body = body.where("kind IS NOT NULL")
    header = content.rlike(SECTION)
    through = Window.partitionBy(key, "__path", "hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(sectioned, F.coalesce(F.last(F.when(header, trimmed), ignorenulls=True).over(through), "start"))
    of_runner = lambda c: F.coalesce(*[F.when(base == name, c.rlike(rx)) for name, rx in RUNNER_SECTIONS.items()], F.lit(False))
    body = body.withColumn("__section", section)
    whole = F.col("__path").rlike(RUNNER_PATH)
    changed = (F.col("kind") != "ctx") & (trimmed != "") & ~((F.col("kind") == "del") & named_package(content, F.col("__target")))
    in_section = F.coalesce(of_runner(F.col("__section")), F.lit(False))
    edit = F.when(whole, changed).when(sectioned & header, (F.col("kind") == "add") & in_section).when(sectioned, changed & in_section).otherwise(False)

    has = lambda sort, rx: (F.col("kind") == sort) & F.col("__own") & content.rlike(rx)
    count = lambda sort, rx: F.count_if(has(sort, rx))
    some = lambda which: F.slice(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("line_no", F.concat(F.when(F.col("kind") == "del", "-").otherwise("+"), trimmed).alias("t"))))), lambda x: x["t"]), 1, 3)  # noqa: E731 (one file of one patch)
    f = body.groupBy(key, *file).agg(
        *[count(sort, rx).alias(f"{name}_{sort}") for name, rx in (("tests", TEST_DEF), ("asserts", ASSERTION), ("skips", SKIP), ("params", PARAMETRIZE), ("trivial", TRIVIAL), ("hooks", COLLECTION_HOOK)) for sort in ("add", "del")],
        F.count_if(F.col("kind") == "del").alias("removed"),
        F.count_if((F.col("kind") != "ctx") & F.col("__own")).alias("touched"),
        F.max(F.when(edit, F.coalesce("__section", F.lit("")))).alias("edited"),
        *[some(which).alias(name) for name, which in (("edit_lines", edit), ("skip_lines", has("add", SKIP)), ("hook_lines", has("add", COLLECTION_HOOK)))],
    )
    deleted = rows.where(F.col("new") == "/dev/null").groupBy(key, F.col("path").alias("__path")).agg(F.count_if(F.col("body")).alias("any")).where("any = 0").select(key, F.col("__path"), F.lit(False).alias("__new_file"), F.lit(True).alias("__deleted_file"))
    f = f.unionByName(deleted, allowMissingColumns=True)  # a deleted file without lines
    test = F.col("__path").rlike(TEST_PATH) & ~F.col("__new_file")
    live = test & ~F.col("__deleted_file")
    less = lambda name: F.col(f"{name}_del") > F.col(f"{name}_add")
    change = lambda name: F.array(F.concat(F.col(f"{name}_del"), F.lit(" removed, "), F.col(f"{name}_add"), F.lit(" added")))
    no_lines = F.array().cast("array<string>")
    found = [
        (test & F.col("__deleted_file"), "test file deleted", F.array(F.concat(F.coalesce("removed", F.lit(0)), F.lit(" lines removed")))),
        (live & less("tests"), "test function removed", change("tests")),
        (live & (F.col("skips_add") > 0), "skip added", F.col("skip_lines")),
        (live & less("asserts"), "assertions removed", change("asserts")),
        (live & less("params"), "parametrisation removed", change("params")),
        (live & (F.col("trivial_add") > 0) & (F.col("asserts_del") > 0) & (F.col("asserts_add") == 0), "test body emptied", no_lines),
        (F.col("edited").isNotNull(), "runner configuration edited", F.concat(F.filter(F.array(F.col("edited")), lambda x: x != ""), F.col("edit_lines"))),
        ((base == "conftest.py") & (F.col("hooks_add") > 0), "collection hook added", F.col("hook_lines")),
    ]
    finding = lambda signal, detail: F.struct(F.col("__path").alias("path"), F.lit(signal).alias("signal"), detail.alias("detail"))
    every = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), finding(signal, detail)) for c, signal, detail in found]))
    edited_test = test & (F.col("__deleted_file") | (F.col("touched") > 0))
    n = f.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(every))).alias("findings"), *[F.array_sort(F.collect_list(F.when(c, F.col("__path")))).alias(name) for name, c in (("modified", edited_test), ("added", F.col("__path").rlike(TEST_PATH) & F.col("__new_file")))])  # one patch
    out = patches.groupBy(key).agg(F.bool_or(F.col(text).isNotNull()).alias("known")).join(n, key, "left")
    nothing = "cast(array() AS array<struct<path:string,signal:string,detail:array<string>>>)"
    out = out.withColumns({"findings": F.coalesce("findings", F.expr(nothing)), **{c: F.coalesce(c, no_lines) for c in ("modified", "added")}})
    signals = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["signal"]))), ",")
    clean = F.concat(F.when(F.size("modified") > 0, F.concat(F.size("modified"), F.lit(" test files modified, none weakened"))).otherwise("no test file modified"), F.when(F.size("added") > 0, F.concat(F.lit("; "), F.size("added"), F.lit(" added"))).otherwise(""))
    reason = F.when(~F.col("known"), "no patch").when(F.size("findings") > 0, F.concat(F.lit("tests weakened: "), F.replace(signals, F.lit(","), F.lit(", ")))).otherwise(clean)
    status = F.when(~F.col("known"), "unverified").when(F.size("findings") > 0, "fail").otherwise("pass")
    return out.select(key, status.alias("status"), signals.alias("signals"), reason.alias("reason"), "findings", "modified", "added")


def closure_gate(before: DataFrame, after: DataFrame, targets: DataFrame, key: str, name: str, target: str) -> DataFrame:
    """G8 (key, status, added, still_present): the resolved names after are among those before, without the target. Packages
    that only build or test don't count. Unverified where the target isn't among those before."""
    clean = lambda t: t.select(key, norm(F.col(name)).alias("name")).where(~F.col("name").isin(*BUILD_TIME)).distinct()
    both = clean(before).withColumn("b", F.lit(True)).join(clean(after).withColumn("a", F.lit(True)), [key, "name"], "full")
    joined = targets.select(key, norm(F.col(target)).alias("target")).join(both, key, "left")
    own = F.col("name") == F.col("target")
    n = joined.groupBy(key).agg(F.coalesce(F.bool_or(own & F.col("b")), F.lit(False)).alias("known"), F.coalesce(F.bool_or(own & F.col("a")), F.lit(False)).alias("still_present"), F.count_if(F.col("a") & F.col("b").isNull() & ~own).alias("added"))
    status = F.when(~F.col("known"), "unverified").when(F.col("still_present") | (F.col("added") > 0), "fail").otherwise("pass")
    return n.select(key, status.alias("status"), "added", "still_present")


def closure_report(submissions: DataFrame, key: str, target: str, declared: DataFrame, observed: DataFrame | None = None, requires: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """G8 (key, status, mode, reason, added, removed, target_still_present, n_before, n_after) with evidence.

    submissions(key, target, edited, applied, gold): does the patch edit a manifest, could the edit be applied, is the
    original manifest known? declared and observed(key, side, name) hold the names before and after, side being 'before'
    or 'after'. A key's mode is 'observed' where observed has both sides of it; else 'metadata' where requires(src, dst) is
    given, and both sides grow by what they require in up to `depth` hops, all keys at once; else 'declared'.

    Packages that only build or test don't count. Without a manifest edit, or with one that can't be applied, it fails. It
    can't speak where the target isn't among the names before, if the original is known, nor for a null target."""
    base = submissions.select(key, norm(F.col(target)).alias("target"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("edited", "applied", "gold")])
    side = lambda name: (F.col("side") == name).alias(name[0])
    clean = lambda rows: rows.select(key, norm(F.col("name")).alias("node"), side("before"), side("after")).where("node IS NOT NULL")
    stated = clean(declared)
    if observed is not None:
        sides = observed.where(norm(F.col("name")).isNotNull()).groupBy(key).agg(F.countDistinct("side").alias("sides"))
        both = to_all(sides.where("sides = 2").select(key))
        stated, seen = stated.join(both, key, "left_anti"), clean(observed).join(both, key, "left_semi")
        base = base.join(both.withColumn("watched", F.lit(True)), key, "left")
    else:
        base = base.withColumn("watched", F.lit(False))
    stated = cut(stated)
    spark, n_stated = stated.sparkSession, stated.count()
    if requires is not None:
        # what a name leads to is followed once, whoever states it
        links = requires.select(norm(F.col("src")).alias("src"), norm(F.col("dst")).alias("dst"))
        nodes = cut(stated.select("node").distinct())
        ahead = closures(links, nodes.select(F.col("node").alias("via"), "node"), ["via"], depth).select("via", "node")
        n_ahead, n_nodes = ahead.count(), max(1, nodes.count())
        met = parts(spark, max(n_stated, n_ahead))
        stated = stated.withColumnRenamed("node", "via").repartition(met, "via").join(ahead.repartition(met, "via"), "via").drop("via")
        n_stated *= n_ahead / n_nodes
    if observed is not None:
        seen = cut(seen)
        stated, n_stated = stated.unionByName(seen), n_stated + seen.count()
    mode = F.when(F.coalesce("watched", F.lit(False)), "observed").otherwise("declared" if requires is None else "metadata")
    n_parts = parts(spark, n_stated)
    dealt = stated.where(~F.col("node").isin(*BUILD_TIME)).repartition(n_parts, key)
    names_ = dealt.groupBy(key, "node").agg(F.bool_or("b").alias("b"), F.bool_or("a").alias("a"))
    own = F.col("node") == F.col("target")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("node"))))  # noqa: E731 (one submission's packages)
    n = base.repartition(n_parts, key).join(names_, key, "left").groupBy(key).agg(
        F.first("target").alias("target"), *[F.first(c).alias(c) for c in ("edited", "applied", "gold")], F.first(mode).alias("mode"),
        F.coalesce(F.bool_or(own & F.col("b")), F.lit(False)).alias("known"), F.coalesce(F.bool_or(own & F.col("a")), F.lit(False)).alias("target_still_present"),
        listed(F.col("a") & ~F.col("b") & ~F.coalesce(own, F.lit(False))).alias("added"), listed(F.col("b") & ~F.col("a") & ~F.coalesce(own, F.lit(False))).alias("removed"), F.count_if("b").alias("n_before"), F.count_if("a").alias("n_after"),
    )
    looked = F.col("mode") != "observed"
    cases = [
        (F.col("target").isNull(), "unverified", F.lit("no target is named")),
        (looked & ~F.col("edited"), "fail", F.lit("no manifest is edited")),
        (looked & ~F.col("applied"), "fail", F.lit("the manifest edit can't be applied")),
        (F.col("gold") & ~F.col("known"), "unverified", F.concat("target", F.lit(" is not among the packages that count"))),
        (F.col("target_still_present"), "fail", F.concat("target", F.lit(" is still there"))),
        (F.size("added") > 0, "fail", F.concat(F.size("added"), F.lit(" packages came: "), F.array_join(F.slice("added", 1, 6), ", "))),
    ]
    status, reason = F, F
    for c, s, r in cases:
        status, reason = status.when(c, s), reason.when(c, r)
    reason = reason.otherwise(F.concat(F.col("n_after"), F.lit(" packages, none of them new")))
    return n.select(key, status.otherwise("pass").alias("status"), "mode", reason.alias("reason"), "added", "removed", "target_still_present", "n_before", "n_after")


def stack(rows: DataFrame, key: str, gates: list[str]) -> DataFrame:
    """V0 and V9 (key, failed, unverified, accepted, rests_on): lists of gates by their status columns, joined by commas;
    accepted without failed and unverified ones; what a rejection rests on. A null status is an absent gate."""
    of = lambda status: F.array_compact(F.array(*[F.when(F.col(g) == status, F.lit(g)) for g in gates]))
    failed, open_ = of("fail"), of("unverified")
    tested = F.size(F.array_except(failed, F.array(*[F.lit(x) for x in UNSTATED]))) > 0
    rests = F.when(tested, "tests or behaviour").when(F.size(failed) > 0, "unstated constraint only")
    return rows.select(key, F.array_join(failed, ",").alias("failed"), F.array_join(open_, ",").alias("unverified"), ((F.size(failed) == 0) & (F.size(open_) == 0)).alias("accepted"), rests.alias("rests_on"))


def activation_status(ci: Column, observed: Column, never_imported: Column) -> Column:
    """V10: may a silent verdict be counted? Only if the block was seen at work, or nothing imports the package."""
    return (
        F.when(ci.isNull(), "no rerun").when(ci != "pass", "rerun failed").when(F.coalesce(observed, F.lit(False)), "counted: block observed")
        .when(F.coalesce(never_imported, F.lit(False)), "counted: never imported").otherwise("excluded: block not observed")
    )
