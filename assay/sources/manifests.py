"""Dependency manifests: removing a dependency, masking, writing; reading is in `declarations`.

files(path, text) go in; the format follows from the file's name. An edit is proven by reading the result with the formats'
full grammars (TOML, XML, JSON, Python), in small helpers over Arrow batches; it declines what it can't read.
"""

from __future__ import annotations

import ast
import configparser
import json
import re
import tomllib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import norm
from .declarations import declared

Found = list[tuple[str, str]]
_requirement = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)")
# an element of an XML file that names a dependency; a comment is matched whole, so that what stands in it stays
_reference = re.compile(r"""(?s)<!--.*?-->|<(Package|Project)Reference\b(?:[^>"']|"[^"]*"|'[^']*')*?(?:/>|>.*?</\1Reference\s*>)""")


def _one(line: str) -> Found:
    m = _requirement.match(line)
    return [(m[1], m[2].strip())] if m else []


def _specifier(value: object) -> str:
    return value if isinstance(value, str) else str(value.get("version", "")) if isinstance(value, dict) else ""


def _pyproject(text: str) -> Found:
    data = tomllib.loads(text)
    listed = data.get("project", {}).get("dependencies")
    if listed:
        return [x for line in listed for x in _one(str(line))]
    poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
    return [(k, _specifier(v)) for k, v in poetry.items() if k != "python"]


def _cargo(text: str) -> Found:
    return [(k, _specifier(v)) for k, v in tomllib.loads(text).get("dependencies", {}).items()]


def _requirements(text: str) -> Found:
    return [x for line in text.splitlines() if not line.lstrip().startswith(("#", "-")) for x in _one(line)]


def _setup_cfg(text: str) -> Found:
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.read_string(text)
    return _requirements(parser.get("options", "install_requires", fallback=""))


def _setup_py(text: str) -> Found:
    tree = ast.parse(text)
    lists = {t.id: n.value for n in ast.walk(tree) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", "")) == "setup"]
    values = [k.value for c in calls for k in c.keywords if k.arg == "install_requires"]
    items = [e for v in (lists.get(x.id) if isinstance(x, ast.Name) else x for x in values) if isinstance(v, ast.List | ast.Tuple) for e in v.elts]
    return [x for e in items if isinstance(e, ast.Constant) and isinstance(e.value, str) for x in _one(e.value)]


def _package_json(text: str) -> Found:
    return [(k, str(v)) for k, v in json.loads(text).get("dependencies", {}).items()]


def _csproj(text: str) -> Found:
    out = []
    for node in ElementTree.fromstring(text).iter():
        tag = node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""
        name = node.get("Include") or node.get("Update")
        if tag in ("PackageReference", "ProjectReference") and name:
            child = next((c.text or "" for c in node if isinstance(c.tag, str) and c.tag.rsplit("}", 1)[-1] == "Version"), "")
            out.append((name, node.get("Version") or child.strip()))
    return out


# File names of the formats; files that lock versions.
FORMATS = (
    (r"pyproject\.toml", _pyproject),
    (r"Cargo\.toml", _cargo),
    (r"setup\.cfg", _setup_cfg),
    (r"setup\.py", _setup_py),
    (r"package\.json", _package_json),
    (r".*\.csproj", _csproj),
    (r"requirements.*\.(?:txt|in)", _requirements),
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "packages.lock.json", "uv.lock")
SUFFIXES = {"python": ".py", "typescript": ".ts", "javascript": ".js", "rust": ".rs", "csharp": ".cs", "java": ".java"}


def _declared(path: str, text: str | None) -> Found | None:
    """None for a file of no known format or one that can't be read."""
    name = path.rsplit("/", 1)[-1]
    read = next((f for rx, f in FORMATS if re.fullmatch(rx, name)), None)
    try:
        return None if read is None else read(text or "")
    except (ValueError, SyntaxError, AttributeError, RecursionError, configparser.Error, ElementTree.ParseError):
        return None


def _key(name: str) -> str:
    return re.sub(r"[-.]", "_", name.lower())


def _without(path: str, text: str | None, name: str) -> str | None:
    """The text without a dependency; None where no edit takes away just that one: read again, never guessed."""
    before = _declared(path, text)
    if not before or _key(name) not in {_key(n) for n, _ in before}:
        return None
    rest = sorted(_key(n) for n, _ in before if _key(n) != _key(name))
    lines = text.splitlines(keepends=True)
    loose = "[-_.]".join(map(re.escape, re.split("[-_.]", name)))
    tries = ["".join(lines[:i] + lines[i + 1 :]) for i, line in enumerate(lines) if re.search(rf"(?i)(?<![\w.-]){loose}(?![\w-])", line)]
    if path.endswith(".csproj"):  # first, since a line of it may be the attribute alone
        tries.insert(0, _reference.sub(lambda m: "" if _key(name) in {_key(n) for n, _ in _declared("x.csproj", m[0]) or ()} else m[0], text))
    item = rf"""(["']){loose}(?![\w-])[^"'\n]*\1(?:\s*:\s*"[^"\n]*")?"""
    tries += [re.sub(rx, "", text, count=1, flags=re.I) for rx in (rf"{item}\s*,\s*", rf",\s*{item}", item)]
    return next((t for t in tries if (after := _declared(path, t)) is not None and sorted(_key(n) for n, _ in after) == rest), None)


def with_included(files: DataFrame, rounds: int = 8) -> DataFrame:
    """(path, name, specifier) of requirement files, with those of the files that -r lines name, followed at most `rounds`
    deep; paths are relative to one tree. A file that includes itself counts once."""
    target = F.regexp_extract("line", r"^\s*(?:-r|--requirement)[ =]\s*(\S+)", 1)
    folder = F.regexp_replace("path", r"[^/]*$", "")
    links = files.select("path", F.explode(F.split("text", r"\r?\n")).alias("line")).select(F.col("path").alias("src"), F.when(target != "", F.concat(folder, target)).alias("dst")).where("dst IS NOT NULL")
    from ..operators.graph import bounded_closure

    reach = bounded_closure(links, rounds).where("root <> node").unionByName(files.select(F.col("path").alias("root"), F.col("path").alias("node")))
    return declared(files).withColumnRenamed("path", "node").join(reach, "node").select(F.col("root").alias("path"), "name", "specifier").distinct()


def without(files: DataFrame, name: str) -> DataFrame:
    """files(path, text, name) with the text that is left without the dependency; null where the edit declines."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "name": b[name], "text": [_without(p, t, n) for p, t, n in zip(b["path"], b["text"], b[name], strict=True)]}, dtype=object)

    return files.select("path", "text", name).mapInPandas(run, "path string, name string, text string")


def masked(files: DataFrame) -> DataFrame:
    """(path, text) without any declared dependency; null where one can't be taken out or none is declared."""

    def mask(path: str, text: str | None) -> str | None:
        found = _declared(path, text)
        for name in {_key(n): n for n, _ in found or ()}.values():
            text = _without(path, text, name)
            if text is None:
                return None
        return text if found else None

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [mask(p, t) for p, t in zip(b["path"], b["text"], strict=True)]}, dtype=object)

    return files.select("path", "text").mapInPandas(run, "path string, text string")


def requirements_text(rows: DataFrame, path: str = "path") -> DataFrame:
    """(path, text): a requirement file of (path, name, specifier), in order of names."""
    parts = F.array_sort(F.collect_set(F.concat("name", F.coalesce("specifier", F.lit("")))))  # one file
    return rows.groupBy(path).agg(F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("text"))


def package_json_text(rows: DataFrame, path: str = "path") -> DataFrame:
    """(path, text): a package.json of (path, name, specifier)."""
    parts = F.array_sort(F.collect_set(F.struct("name", "specifier")))  # one file
    return rows.groupBy(path).agg(F.to_json(F.struct(F.map_from_entries(parts).alias("dependencies"))).alias("text"))


def cargo_text(rows: DataFrame, path: str = "path") -> DataFrame:
    """(path, text): the [dependencies] of a Cargo.toml."""
    parts = F.array_sort(F.collect_set(F.concat("name", F.lit(' = "'), F.coalesce("specifier", F.lit("*")), F.lit('"'))))
    return rows.groupBy(path).agg(F.concat(F.lit("[dependencies]\n"), F.array_join(parts, "\n"), F.lit("\n")).alias("text"))


def without_lock_files(files: DataFrame) -> DataFrame:
    return files.where(~F.element_at(F.split("path", "/"), -1).isin(*LOCK_FILES))


def build_files(files: DataFrame) -> DataFrame:
    """(path, dependencies): manifests that declare something."""
    return declared(files).groupBy("path").agg(F.count("*").alias("dependencies"))


def tree_lines(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, line) of the folders and files of a tree, indented by depth; dotted entries are left out. Order by path."""
    parts = F.split(path, "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nodes = files.where(~F.exists(parts, lambda p: p.startswith("."))).select(F.explode(starts).alias("path")).distinct()
    depth = F.size(F.split("path", "/")) - 1
    return nodes.select("path", F.concat(F.repeat(F.lit("  "), depth), F.element_at(F.split("path", "/"), -1)).alias("line"))


def suffix_of(language: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.lower(language))


def declares_elsewhere(files: DataFrame, wanted: DataFrame, key: str, dep: str) -> DataFrame:
    """(key, dep, path): the first file, by path, of wanted(key, dep)'s tree, files(key, path, text), a line of which begins
    with the package's name: a second source that would install it."""
    first = norm(F.regexp_extract("line", r"^\s*['\"]?([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    lines = files.select(key, "path", F.explode(F.split("text", r"\r?\n")).alias("line")).select(key, "path", first.alias("n")).where("n <> ''").distinct()
    hits = wanted.select(key, dep, norm(F.col(dep)).alias("n")).join(lines, [key, "n"])
    return hits.groupBy(key, dep).agg(F.min("path").alias("path"))
