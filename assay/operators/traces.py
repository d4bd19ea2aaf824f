"""Recorded calls: extraction from logs, fidelity, observability, shifts, counterfeits; call graphs and module graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import root_name, tail_name
from .graph import to_all

#: The classes of a recorded value from best to worst.
CLASSES = ("exact", "array", "hashed", "structural", "opaque", "truncated")


def trace_states(lines: DataFrame, verdicts: DataFrame, key: str, line: str, marker: str, loaded: str, ci: str) -> DataFrame:
    """(key, calls, malformed, state): the state of each run in verdicts(key, ci) by its log lines(key, line). Calls stand as
    JSON behind the marker. A run that isn't green is 'not green' whatever was recorded."""
    has = F.col(line).contains(marker)
    body = F.substring_index(F.col(line), marker, -1)
    good = has & F.try_parse_json(body).isNotNull()
    n = lines.groupBy(key).agg(F.count_if(good).alias("calls"), F.count_if(has & ~good).alias("malformed"), F.bool_or(F.col(line).contains(loaded)).alias("on"))
    both = verdicts.select(key, F.col(ci).alias("ci")).join(n, key, "left")
    state = F.when(~F.col("ci").eqNullSafe("pass"), "not green").when(F.col("calls") > 0, "traced").when(F.col("on"), "loaded, no call").otherwise("never loaded")
    return both.select(key, F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("malformed", F.lit(0)).alias("malformed"), state.alias("state"))


#: Types whose recorded value is the whole value.
PRIMITIVE = ("NoneType", "bool", "int", "float", "complex")
TEXT = ("str", "bytes", "bytearray")


def value_class(json: Column, depth: int = 3, mixed: str = "worst") -> Column:
    """The class of a recorded value (JSON, read as VARIANT): exact, array, hashed, structural, opaque or truncated. What
    isn't an object is exact; what isn't JSON is null.

    A container with more members than were recorded, or a truncated one, is truncated. Else it has the class of its worst
    member, or with mixed="best" of its best one, which is what published figures count; the worst is the safe rule, since a
    difference inside an opaque member would be missed. Maps are lists of pairs; their values count. Members deeper than
    `depth` count by their own form only."""
    return _variant_class(F.try_parse_json(json), depth, mixed)


def _variant_class(v: Column, depth: int, mixed: str) -> Column:
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    has = lambda key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()  # noqa: E731 (a JSON null counts as there)
    kind, n = get("t", "string"), F.coalesce(get("n", "bigint"), F.lit(0))
    text = F.when(n > F.length(F.coalesce(get("v", "string"), F.lit(""))), "truncated").otherwise("exact")
    items = get("items", "array<variant>")
    worst = len(CLASSES) - 1
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in CLASSES]), c).cast("int") - 1
    member = lambda i: F.when(kind == "dict", F.try_variant_get(i, "$[1]", "variant")).otherwise(i)
    ranks = F.transform(items, lambda i: rank(_variant_class(member(i), depth - 1, mixed)) if depth else F.lit(0))
    # -1: no member yet; a truncated member decides in both rules
    join = lambda a, r: F.when((a == worst) | (r == worst), worst).when(a < 0, r).otherwise(F.greatest(a, r) if mixed == "worst" else F.least(a, r))
    inner = F.aggregate(ranks, F.lit(-1), join, lambda a: F.element_at(F.array(*[F.lit(x) for x in CLASSES]), F.greatest(a, F.lit(0)) + 1))
    return (
        F.when(v.isNull(), F.lit(None)).when(~F.schema_of_variant(v).startswith("OBJECT"), "exact").when(has("h"), "hashed").when(kind.isin(*TEXT), text)
        .when(kind.isin(*PRIMITIVE), "exact").when(items.isNotNull(), F.when(n > F.size(items), "truncated").otherwise(inner)).when(has("list"), "array")
        .when(has("attrs") | has("len"), "structural").otherwise("opaque")
    )


def fidelity(calls: DataFrame, value: str) -> DataFrame:
    """(class, n, share) of recorded values."""
    n = calls.where(F.col(value).isNotNull()).groupBy(value_class(F.col(value)).alias("class")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # six rows at most


def record_fidelity(records: DataFrame, record: str, cap: str, mixed: str = "best") -> DataFrame:
    """(class, n, share, decided) of recorded calls, each an object with `ret` or `raised`; a call that raised is of the class
    exception, one without either is exact. decided: does a comparison of such values look at the whole value? Headers of
    capped files, which have a true `cap`, and lines that aren't JSON don't count."""
    v = F.try_parse_json(record)
    rows = records.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(F.try_variant_get("v", f"$.{cap}", "boolean"), F.lit(False)))
    of = lambda key: F.try_variant_get(F.col("v"), f"$.{key}", "variant")
    kind = F.when(of("raised").isNotNull(), "exception").otherwise(F.coalesce(_variant_class(of("ret"), 3, mixed), F.lit("exact")))
    n = rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # seven rows at most
    return n.select("class", "n", share.alias("share"), F.col("class").isin("exact", "array", "hashed", "structural", "exception").alias("decided"))


def observability(calls: DataFrame, pair: str, function: str, void: Column, opaque: Column) -> DataFrame:
    """(level, what, n) on three levels: calls, functions of a pair, pairs. A function is observable that returns a value on
    some call and takes no live object on any."""
    flagged = calls.select(pair, tail_name(F.col(function)).alias("f"), void.alias("void"), opaque.alias("opaque"))
    functions = flagged.groupBy(pair, "f").agg(F.count("*").alias("calls"), F.count_if("void").alias("voids"), F.count_if("opaque").alias("opaques"), F.bool_and("void").alias("void"), F.bool_or("opaque").alias("opaque"))
    what = F.when(F.col("void"), "returns nothing").when(F.col("opaque"), "takes a live object").otherwise("observable")
    pairs = functions.groupBy(pair).agg(F.bool_or(~F.col("void") & ~F.col("opaque")).alias("seen"))
    per_call = functions.agg(F.sum("calls").alias("c"), F.sum("voids").alias("v"), F.sum("opaques").alias("o"))
    rows = F.array(*[F.struct(F.lit("call").alias("level"), F.lit(w).alias("what"), c.alias("n")) for w, c in (("returns a value", F.col("c") - F.col("v")), ("returns nothing", F.col("v")), ("takes a live object", F.col("o")), ("arguments can be written down", F.col("c") - F.col("o")))])
    out = per_call.where("c IS NOT NULL").select(F.explode(rows).alias("x")).select("x.*")
    out = out.unionByName(functions.groupBy(what.alias("what")).agg(F.count("*").alias("n")).select(F.lit("function").alias("level"), "what", "n"))
    return out.unionByName(pairs.groupBy(F.when(F.col("seen"), "observable").otherwise("not observable").alias("what")).agg(F.count("*").alias("n")).select(F.lit("pair").alias("level"), "what", "n"))


def shift_sensitivity(left: DataFrame, right: DataFrame, site: str, order: str, value: str, by: int) -> DataFrame:
    """One row: how many calls of left pair with an equal one of right by site, and how many if right's sites are moved."""
    from ..functions.names import shift_site
    from .relate import positional_pairs

    def equal(r: DataFrame, name: str) -> DataFrame:
        pairs = positional_pairs(left, r, site, order, value)
        return pairs.agg(F.count_if(F.col("a").eqNullSafe(F.col("b")) & F.col("a").isNotNull()).alias(name))

    moved = right.withColumn(site, shift_site(F.col(site), by))
    return equal(right, "as_recorded").crossJoin(equal(moved, "shifted"))  # one row each


def counterfeits(fakes: DataFrame, calls: DataFrame, key: str, fake: str, returned: str) -> DataFrame:
    """(key, n, equal, convincing): against how many recorded returns a fake value was held, and whether it differs from all
    of them. A fake without recorded returns is not convincing."""
    both = fakes.select(key, F.col(fake).alias("f")).join(calls.select(key, F.col(returned).alias("r")), key, "left")
    n = both.groupBy(key).agg(F.count("r").alias("n"), F.count_if(F.col("f") == F.col("r")).alias("equal"))
    return n.withColumn("convincing", (F.col("n") > 0) & (F.col("equal") == 0))


def external_roots(edges: DataFrame, internal: DataFrame, caller: str, callee: str, name: str) -> DataFrame:
    """(root, symbols, sites): callees whose first name part isn't internal(name), by that part."""
    rooted = edges.select(caller, callee, root_name(F.col(callee)).alias("root"))
    out = rooted.join(internal.select(F.col(name).alias("root")).distinct(), "root", "left_anti")
    return out.groupBy("root").agg(F.countDistinct(callee).alias("symbols"), F.count("*").alias("sites"))


def module_edges(imports: DataFrame, modules: DataFrame, path: str, imported: str, module: str) -> DataFrame:
    """(src, dst): files of imports(path, imported) to the file of modules(path, module) with the longest module name that is
    the imported name or a dotted beginning of it. Each different name is looked up once, by an equi-join of its beginnings, so
    a module that everyone imports stands for few rows there."""
    parts = F.split(imported, r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    tried = imports.select(imported).distinct().select(imported, F.explode(starts).alias(module))
    hit = tried.join(to_all(modules.select(module, F.col(path).alias("dst"))), module)
    best = to_all(hit.groupBy(imported).agg(F.max_by("dst", F.struct(F.length(module), "dst")).alias("dst")))
    return imports.select(F.col(path).alias("src"), imported).join(best, imported).where("src <> dst").select("src", "dst").distinct()


def footprint(imports: DataFrame, aliases: DataFrame, tests: Column, path: str, imported: str, dep: str, alias: str) -> DataFrame:
    """(dep, files, test_files): files outside and inside of tests that import a package under any of its names(dep, alias)."""
    used = imports.select(path, root_name(F.col(imported)).alias(alias)).distinct().join(aliases, alias).select(dep, path).distinct()
    n = used.groupBy(dep).agg(F.count_if(~tests).alias("files"), F.count_if(tests).alias("test_files"))
    return aliases.select(dep).distinct().join(n, dep, "left").na.fill(0, ["files", "test_files"])


def guard_verdict(sites: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, sites, verdict) of import sites by kind: recovers, fallback_to, reraises or unguarded."""
    soft = F.col(kind).isin("recovers", "fallback_to")
    n = sites.groupBy(key).agg(F.count(kind).alias("sites"), F.bool_and(soft).alias("soft"))
    return n.select(key, "sites", F.when(F.col("sites") == 0, "never imported").when(F.col("soft"), "optional by design").otherwise("required").alias("verdict"))


def import_sites(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, imported, kind) of the imports of Python files, and how each is guarded against a missing package. A
    grammar, so a small helper over Arrow batches; files that don't parse give no rows."""
    import ast

    import pandas as pd

    def guards(handler: ast.ExceptHandler) -> bool:
        return handler.type is None or any(getattr(x, "id", getattr(x, "attr", "")) in ("ImportError", "ModuleNotFoundError") for x in ast.walk(handler.type))

    def ends(handler: ast.ExceptHandler) -> bool:
        names = (getattr(x.func, "id", getattr(x.func, "attr", "")) for x in ast.walk(handler) if isinstance(x, ast.Call))
        return any(isinstance(x, ast.Raise) for x in ast.walk(handler)) or any(n in ("exit", "_exit") for n in names)

    def visit(node: ast.AST, kind: str, out: list[tuple[int, str, str]]) -> None:
        if isinstance(node, ast.Import):
            out += [(node.lineno, a.name, kind) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and not node.level:
            out.append((node.lineno, node.module or "", kind))
        mine = [h for h in node.handlers if guards(h)] if isinstance(node, ast.Try) else []
        for child in ast.iter_child_nodes(node):
            if mine and child in node.body:
                visit(child, "reraises" if all(map(ends, mine)) else "recovers", out)
            else:
                visit(child, "fallback_to" if child in mine else kind, out)

    def run(batches):
        for b in batches:
            rows = []
            for p, t in zip(b[path], b[text], strict=True):
                try:
                    found: list[tuple[int, str, str]] = []
                    visit(ast.parse(t or ""), "unguarded", found)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(p, *x) for x in found]
            yield pd.DataFrame(rows, columns=["path", "line", "imported", "kind"])

    return files.select(path, text).mapInPandas(run, "path string, line int, imported string, kind string")
