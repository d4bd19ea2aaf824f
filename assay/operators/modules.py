"""Module graphs of many repositories at once: what files import, what that leads to, and what a package's footprint is.

Python's grammar gives only the bare statements, one row each, from a table function that is called laterally, once for each
different text; names are resolved, counted and followed by joins. Files that don't parse have no rows. Null repositories,
paths or texts are left out.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.names import is_test_path
from .graph import cut, reach, to_all


def statements_of(source: str | None) -> Iterator[tuple[str, int, int, str, str | None, str | None]]:
    """(kind, line, level, module, name, bound): an import ('import', module is what is imported), an imported name ('from'),
    or a use ('use', bound is the name whose attribute is read or that is called)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                for a in names:
                    yield "import", node.lineno, 0, a.name, None, (a.asname or a.name).split(".")[0]
            case ast.ImportFrom(names=names, module=module, level=level):
                for a in names:
                    yield "from", node.lineno, level or 0, module or "", a.name, a.asname or a.name
            case ast.Attribute(value=ast.Name(id=name)) | ast.Call(func=ast.Name(id=name)):
                yield "use", node.lineno, 0, "", None, name


@udtf(returnType="kind string, line int, level int, module string, name string, bound string")
class Statements:
    def eval(self, source: str):
        yield from statements_of(source)


#: Up to so many statements of different texts every task gets them all.
STATEMENTS = 200_000


def module_name(path: Column) -> Column:
    """The dotted name of a file, from the root or from src/; a package's is that of its folder."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.py$", "")
    return F.replace(F.regexp_replace(bare, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def module_graph(files: DataFrame, repo: str = "repo", path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of files(repo, path, text): edges(repo, src, dst) between files; packages(repo, path, top, statements, uses) that are
    neither of the repository nor Python's own; and all(repo, path, test).

    A relative import starts at the file's package and goes up a folder for each further dot. An imported name leads to the
    file with the longest module name that is a dotted beginning of it; from a module, both it and module.name are tried."""
    known = files.select(F.col(repo).alias("repo"), F.col(path).alias("path"), F.col(text).alias("text")).where("repo IS NOT NULL AND path IS NOT NULL AND text IS NOT NULL")
    # copies are parsed once: a file is then its text's digest, and its statements come back by that
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    texts = known.select(digest, "text").groupBy("digest").agg(F.first("text").alias("text"))  # of one digest all are equal
    stated = to_all(texts.lateralJoin(Statements(F.col("text").outer())).drop("text"), STATEMENTS)
    known = cut(known.select("repo", "path", digest))
    every = known.select("repo", "path", is_test_path(F.col("path")).alias("test"))
    modules = known.select("repo", module_name(F.col("path")).alias("module"), "path").where("module <> ''").groupBy("repo", "module").agg(F.min("path").alias("dst"))
    tops = modules.select("repo", F.split_part("module", F.lit("."), F.lit(1)).alias("top")).distinct()

    inside = F.split(module_name(F.col("path")), r"\.")
    folder = F.when(F.col("path").rlike(r"(^|/)__init__\.py$"), inside).otherwise(F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0))))
    base = F.slice(folder, 1, F.greatest(F.size(folder) - F.greatest(F.col("level") - 1, F.lit(0)), F.lit(0)))
    parts = F.filter(F.concat(base, F.array("module")), lambda p: p != "")
    target = F.when(F.col("level") > 0, F.array_join(parts, ".")).otherwise(F.col("module"))
    found = known.join(stated.where("kind <> 'use'"), "digest").drop("digest").withColumn("target", target)
    deep = F.concat_ws(".", F.nullif("target", F.lit("")), "name")
    names = found.select("repo", F.col("path").alias("src"), F.explode(F.array_distinct(F.array_compact(F.array("target", deep)))).alias("wanted"))
    steps = F.split("wanted", r"\.")
    tried = names.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "."))).alias("module"))
    # a name that begins with a module of the repository is its own, so that needs no join before this one
    met = tried.join(modules, ["repo", "module"]).groupBy("repo", "src", "wanted").agg(F.max_by("dst", F.length("module")).alias("dst"))
    edges = met.select("repo", "src", "dst").where("src <> dst").distinct()

    outside = found.where("level = 0").withColumn("top", F.split_part("target", F.lit("."), F.lit(1)))
    foreign = outside.where(~F.col("top").isin(*sys.stdlib_module_names, "__future__", "_typeshed")).join(tops, ["repo", "top"], "left_anti")
    # a name that is bound twice stands for what was bound last
    bound = foreign.groupBy("repo", "path", "bound").agg(F.max_by("top", F.struct("line", "top")).alias("top"))
    calls = stated.where("kind = 'use'").groupBy("digest", "bound").agg(F.count("*").alias("n"))
    used = known.join(to_all(calls, STATEMENTS), "digest").select("repo", "path", "bound", "n")
    uses = used.join(bound, ["repo", "path", "bound"]).groupBy("repo", "path", "top").agg(F.sum("n").alias("uses"))
    counted = foreign.groupBy("repo", "path", "top").agg(F.countDistinct("line").alias("statements"))
    return edges, counted.join(uses, ["repo", "path", "top"], "left").na.fill(0, ["uses"]), every


def footprints(files: DataFrame, aliases: DataFrame, dep: str, alias: str, repo: str = "repo", path: str = "path", text: str = "text") -> DataFrame:
    """(repo, dep, files, test_files, uses, reachable) of packages that a repository imports under a name in aliases(dep,
    alias): importing files outside and inside of tests, uses of what they bind from it, and whether a test file leads to
    one of them, or is one. Reachability goes from the test files of all repositories in one breadth-first run."""
    edges, packages, every = module_graph(files, repo, path, text)
    node = lambda c: F.struct("repo", F.col(c).alias("path"))
    seen = reach(edges.select(node("src").alias("src"), node("dst").alias("dst")), every.where("test").select(node("path").alias("node")))
    reached = seen.select("node.repo", "node.path", F.lit(True).alias("reached"))
    hit = packages.join(aliases.select(dep, F.col(alias).alias("top")).distinct(), "top").groupBy("repo", dep, "path").agg(F.sum("uses").alias("uses"))
    marked = hit.join(every, ["repo", "path"]).join(reached, ["repo", "path"], "left")
    return marked.groupBy("repo", dep).agg(F.count_if(~F.col("test")).alias("files"), F.count_if("test").alias("test_files"), F.sum("uses").alias("uses"), F.bool_or(F.coalesce("reached", F.lit(False))).alias("reachable"))
