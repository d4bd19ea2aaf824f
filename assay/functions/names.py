"""Names, paths, identifiers and log lines as column expressions. The four key rules differ on purpose."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(name: Column) -> Column:
    """Lower case, hyphens and dots to underscores."""
    return F.translate(F.lower(name), "-.", "__")


def metric_name(name: Column) -> Column:
    """Lower case and hyphens to underscores; dots stay."""
    return F.translate(F.lower(name), "-", "_")


def requirement_name(line: Column) -> Column:
    """The package a requirement line names; null for comments, options and empty lines."""
    bare = F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))
    name = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.when((name != "") & ~bare.startswith("-"), name)


def id_part(composite: Column, part: int) -> Column:
    """Part of <base>__<kind>__<dependency>: 1 the base, 2 the kind, -1 the dependency."""
    return F.split_part(composite, F.lit("__"), F.lit(part))


# What makes a path one of tests, by who asks.
TEST_PATHS = {
    "gate": r"(^|/)(tests?|testing|unittests?|integration_tests)/|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$|(^|/)tests\.py$",
    "footprint": r"(^|/)(tests?|testing|unit_?tests|integration_tests)/|(^|/)test_[^/]*$|_test\.py$|(^|/)conftest\.py$|(^|/)tests\.py$",
    "review": r"(^|/)(tests?|testing)(/|$)|(^|/)test_|_test\.py$|conftest\.py$",
}


def is_test_path(path: Column, rule: str = "footprint") -> Column:
    """Is path in a folder of tests, or named as a test? rule is one of TEST_PATHS. Null for a null path."""
    return path.rlike(TEST_PATHS[rule])


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[A-Za-z]", "")


def whole_word(text: Column, word: str) -> Column:
    """Does word, taken literally, stand in text without a letter, digit or underscore beside it?"""
    return text.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(word)}($|[^\p{{L}}\p{{N}}_])")


def lines(text: Column) -> Column:
    """Lines without a trailing empty one."""
    return F.split(F.regexp_replace(text, r"(\r\n|[\n\r])\z", ""), r"\r\n|[\n\r]")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def suite_verdict(summary: Column) -> Column:
    """pass, fail or null from a test summary line."""
    return F.when(summary.rlike(r"\b[1-9][0-9]* (failed|errors?)\b"), "fail").when(summary.rlike(r"\b[1-9][0-9]* passed\b"), "pass")


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def shift_site(site: Column, by: int) -> Column:
    """path:line moved by so many lines."""
    line = F.element_at(F.split(site, ":"), -1)
    return F.concat(F.regexp_replace(site, r"[0-9]+$", ""), (line.cast("int") + by).cast("string"))
