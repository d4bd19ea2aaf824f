"""What dependency manifests declare, read by column expressions: sections, bracketed lists and tags, without a parser outside
of Spark. The format follows from the file's name. What a format's rules can't make out gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import balanced_end

# File names of the formats, by the name that file_format() gives.
FORMATS = {
    "pyproject": r"(^|/)pyproject\.toml$",
    "cargo": r"(^|/)Cargo\.toml$",
    "setup.cfg": r"(^|/)setup\.cfg$",
    "setup.py": r"(^|/)setup\.py$",
    "package.json": r"(^|/)package\.json$",
    "csproj": r"\.csproj$",
    "requirements": r"(^|/)requirements[^/]*\.(txt|in)$",
}
_QUOTED = r"""\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"""
_HEADER = r"(?m)^\[([^\[\]\n]+)\][ \t]*$"
_DEPENDENCY = "struct<name:string,specifier:string>"


def file_format(path: Column) -> Column:
    """The format of a manifest, null for other files."""
    return F.coalesce(*[F.when(path.rlike(rx), name) for name, rx in FORMATS.items()])


def without_comments(text: Column) -> Column:
    """Text without # comments; quoted strings of one line stay as they are."""
    return F.regexp_replace(text, rf"({_QUOTED})|#[^\n]*", "$1")


def sections(text: Column) -> Column:
    """Array of (header, body) of a file in [sections]; lines before the first header are left out."""
    heads = F.regexp_extract_all(text, F.lit(_HEADER), F.lit(1))
    return F.zip_with(heads, F.slice(F.split(text, _HEADER, -1), 2, F.size(heads)), lambda h, b: F.struct(F.trim(h).alias("header"), b.alias("body")))


def _body(found: Column, header: str) -> Column:
    return F.array_join(F.transform(F.filter(found, lambda s: s["header"] == header), lambda s: s["body"]), "\n")


def _requirements(lines: Column) -> Column:
    rx = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)"
    found = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, rx, 1).alias("name"), F.trim(F.regexp_extract(x, rx, 2)).alias("specifier")))
    return F.filter(found, lambda d: d["name"] != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n|[\r\n]"), lambda x: ~F.ltrim(x).rlike("^[#-]"))


def _strings(code: Column) -> Column:
    """The quoted strings of a list, without their quotes."""
    return F.transform(F.regexp_extract_all(code, F.lit(_QUOTED), F.lit(0)), lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))


def _list_at(text: Column, opening: str) -> Column:
    """The bracketed list that begins with the last character of the first match of a pattern; empty without one, or if it
    stays open."""
    lead = F.regexp_extract(text, rf"(?ms)\A(.*?{opening})", 1)
    end = balanced_end(text, F.length(lead) - 1)
    return F.when((lead != "") & (end > 0), F.substring(text, F.length(lead), end - F.length(lead) + 1)).otherwise("")


def _table(body: Column) -> Column:
    """name = "version" and name = { version = "..." } lines of a table."""
    rx = r"^\s*(?:\"([^\"]+)\"|'([^']+)'|([A-Za-z0-9._-]+))\s*=\s*(.*?)\s*$"
    part = lambda x, i: F.regexp_extract(x, rx, i)
    version = lambda v: F.when(v.rlike("^[\"']"), F.regexp_extract(v, r"^[\"']([^\"']*)[\"']", 1)).when(v.startswith("{"), F.regexp_extract(v, r"\bversion\s*=\s*[\"']([^\"']*)[\"']", 1)).otherwise("")
    found = F.transform(F.split(body, r"\r?\n"), lambda x: F.struct(F.concat(part(x, 1), part(x, 2), part(x, 3)).alias("name"), version(part(x, 4)).alias("specifier")))
    return F.filter(found, lambda d: d["name"] != "")


def _subtables(found: Column, prefix: str) -> Column:
    """[prefix.name] sections with a version line."""
    inner = F.filter(found, lambda s: s["header"].startswith(f"{prefix}."))
    return F.transform(inner, lambda s: F.struct(F.regexp_replace(F.substring(s["header"], F.lit(len(prefix) + 2), F.length(s["header"])), "[\"']", "").alias("name"), F.regexp_extract(s["body"], r"(?m)^\s*version\s*=\s*[\"']([^\"']*)[\"']", 1).alias("specifier")))


def dependencies(path: Column, text: Column) -> Column:
    """Array of (name, specifier) that a manifest declares, in its order; null for files of no known format.

    pyproject.toml: the project's list, or else poetry's table without python itself. setup.cfg: install_requires of
    [options]. setup.py: install_requires as a list, or a name that is bound to one. Cargo.toml: [dependencies] and its
    sub-tables. csproj: package and project references, comments left out. A null text declares nothing."""
    bare = without_comments(F.coalesce(text, F.lit("")))
    found = sections(bare)
    listed = _requirements(_strings(_list_at(_body(found, "project"), r"^\s*dependencies\s*=\s*\[")))
    poetry = F.filter(F.concat(_table(_body(found, "tool.poetry.dependencies")), _subtables(found, "tool.poetry.dependencies")), lambda d: d["name"] != "python")
    options = F.regexp_extract(_body(found, "options"), r"(?ms)^install_requires[ \t]*=[ \t]*(.*?)(?=^\S|\z)", 1)
    bound = F.regexp_extract(bare, r"\binstall_requires\s*=\s*([A-Za-z_]\w*)\b", 1)
    assigned = F.when(bound != "", F.regexp_extract(F.regexp_substr(bare, F.concat(F.lit(r"(?ms)^[ \t]*"), bound, F.lit(r"[ \t]*=[ \t]*[\[(].*\z"))), r"(?s)=[ \t]*([\[(].*)\z", 1)).otherwise(F.regexp_extract(bare, r"(?s)\binstall_requires\s*=\s*([\[(].*)\z", 1))
    setup = _requirements(_strings(F.substring(assigned, F.lit(1), F.greatest(balanced_end(assigned, F.lit(0)), F.lit(0)))))
    tag = r"(?s)<(?:Package|Project)Reference\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?</(?:Package|Project)Reference>)"
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", ""), F.lit(tag), F.lit(0))
    attribute = lambda x, name: F.regexp_extract(x, rf"\A[^>]*?\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    either = lambda a, b: F.when(a != "", a).otherwise(b)
    references = F.filter(F.transform(tags, lambda x: F.struct(either(attribute(x, "Include"), attribute(x, "Update")).alias("name"), either(attribute(x, "Version"), F.regexp_extract(x, r"(?s)<Version>\s*(.*?)\s*</Version>", 1)).alias("specifier"))), lambda d: d["name"] != "")
    pairs = F.map_entries(F.from_json(F.get_json_object(text, "$.dependencies"), "map<string,string>"))
    json = F.coalesce(F.transform(pairs, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("specifier"))), F.array().cast(f"array<{_DEPENDENCY}>"))
    kind = file_format(path)
    by = {"pyproject": F.when(F.size(listed) > 0, listed).otherwise(poetry), "cargo": F.concat(_table(_body(found, "dependencies")), _subtables(found, "dependencies")), "setup.cfg": _requirements(_lines(options)), "setup.py": setup, "package.json": json, "csproj": references, "requirements": _requirements(_lines(F.coalesce(text, F.lit(""))))}
    return F.coalesce(*[F.when(kind == name, value) for name, value in by.items()])


def declared(files: DataFrame) -> DataFrame:
    """(path, name, specifier) of every dependency that a manifest of files(path, text) declares."""
    return files.select("path", F.explode(dependencies(F.col("path"), F.col("text"))).alias("d")).select("path", "d.name", "d.specifier")
