"""Code, logs and recorded values as column expressions."""

from __future__ import annotations

import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of tokens, in the order in which they are tried: strings, comments, numbers, names, other signs.
STRING = r"""[rRbBuUfF]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"""
COMMENT = r"#[^\n]*"
NUMBER = r"[0-9][\p{L}\p{N}_.]*"
NAME = r"[A-Za-z_][\p{L}\p{N}_]*"
SIGN = r"[^\s\p{L}\p{N}_]"
TOKEN = f"{STRING}|{COMMENT}|{NUMBER}|{NAME}|{SIGN}"


def code_tokens(source: Column) -> Column:
    """Tokens with strings, numbers and names as S, N and I, keywords and signs as they are, comments dropped; a quote that
    nothing closes is a sign. Null for null."""
    found = F.filter(F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("#"))
    kind = lambda t: F.when((F.length(t) > 1) & t.rlike("[\"']"), "S").when(t.rlike("^[0-9]"), "N").when(t.rlike("^[A-Za-z_]") & ~t.isin(*keyword.kwlist), "I").otherwise(t)
    return F.transform(found, kind)


def spelling_variants(name: Column, least: int = 3) -> Column:
    """The spellings of a package name that texts use, in lower case."""
    low = F.lower(name)
    swap = lambda a, b: F.replace(low, F.lit(a), F.lit(b))
    return F.array_distinct(F.filter(F.array(low, swap("-", "_"), swap("_", "-"), swap("_", ""), swap("-", "")), lambda v: F.length(v) >= least))


def strip_log_prefix(text: Column) -> Column:
    """[job] | at the beginning of each line."""
    return F.regexp_replace(text, r"(?m)^\[[^\]\n]*\][ \t]*\|?[ \t]*", "")


def first_boolean(*values: Column) -> Column:
    """The first value that isn't null, as a Boolean: pass, passed, success and true are true, other words false."""
    return F.lower(F.coalesce(*values)).isin("pass", "passed", "success", "true")


def ci_verdict(out: Column, exit_code: Column) -> Column:
    """pass or fail of a CI log: a bad exit code, no step run, or a failed job each fail; else a job must have succeeded."""
    ran = out.contains("⭐ Run Main") | out.contains("⭐  Run Main")
    return F.when(exit_code != 0, "fail").when(~ran, "fail").when(out.contains("🏁  Job failed"), "fail").when(out.contains("🏁  Job succeeded"), "pass").otherwise("fail")


def run_verdict(out: Column, err: Column) -> Column:
    """pass, fail or null of a test run by its last three lines that aren't blank; a traceback at the end of err fails too."""
    kept = F.filter(F.split(F.coalesce(out, F.lit("")), r"\r\n|[\n\r]"), lambda line: F.trim(line) != "")
    tail = F.array_join(F.slice(kept, F.greatest(F.size(kept) - 2, F.lit(1)), 3), " ")
    passed = tail.rlike(r"\b\d+ passed")
    bad = tail.contains("no tests ran") | (F.lower(tail).contains("error") & ~tail.contains("passed")) | tail.rlike(r"\b\d+ (failed|error)")
    broken = tail.contains("Interrupted") | F.coalesce(F.right(err, F.lit(2000)).contains("Traceback"), F.lit(False))
    return F.when(bad, "fail").when(passed, "pass").when(broken, "fail")


def tail_name(qualified: Column) -> Column:
    return F.split_part(qualified, F.lit("."), F.lit(-1))


def root_name(qualified: Column) -> Column:
    return F.split_part(qualified, F.lit("."), F.lit(1))


def installed_pattern(name: Column) -> Column:
    """A pattern that finds a package in an install log; hyphens, underscores and dots in its name are alike.

    Fixed values: the ways in which installers name a package."""
    n = F.regexp_replace(F.regexp_replace(name, r"([^A-Za-z0-9_.-])", r"\\$1"), r"[-_.]", "[-_.]")
    alone, ends = F.lit(r"(^|[^A-Za-z0-9_.\-])"), F.lit(r"($|[^A-Za-z0-9_.\-])")
    return F.concat(F.lit("(?i)("), alone, n, F.lit(r"-\d|"), alone, n, F.lit(r"==\d|(Installing|Updating|Downgrading) "), n, F.lit(r" \(\d|Requirement already satisfied: "), n, ends, F.lit("|collected packages:.*"), alone, n, ends, F.lit(")"))


def is_opaque(value: str) -> str:
    """SQL: is a recorded value (a struct with its type's name in t) a live object, which can't be written down again?"""
    return f"({value}.t NOT IN ('int', 'float', 'str', 'bool', 'NoneType', 'bytes', 'bytearray', 'complex'))"
