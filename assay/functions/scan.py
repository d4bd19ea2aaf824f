"""Balanced brackets and the macros that need them, as column expressions of linear cost: a text is cut into quoted strings,
brackets and what lies between, and one fold keeps the depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A string ends at its quote, a backslash takes the next character along; an open one goes to the end of the text.
_STRING = r"""(?s)"(?:\\.|[^"\\])*+(?:"|\\?\z)|'(?:\\.|[^'\\])*+(?:'|\\?\z)"""
BRACKETS = _STRING + r"""|[\[({]|[\])}]|[^"'\[\](){}]++"""
BRACES = r"(?s)[{}]|[^{}]++"
HEAD = r"\\newcommand\{\\([A-Za-z]+)\}\{"


def _end(text: Column, pieces: str, depth: int) -> Column:
    """Offset behind the closing bracket that returns to depth zero; null if none does."""
    opens, closes = F.array(*map(F.lit, "[({")), F.array(*map(F.lit, "])}"))
    start = F.struct(F.lit(depth).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(a: Column, piece: Column) -> Column:
        now = a["depth"] + F.when(F.array_contains(opens, piece), 1).when(F.array_contains(closes, piece), -1).otherwise(0)
        at = a["at"] + F.length(piece)
        closed = a["end"].isNull() & F.array_contains(closes, piece) & (now == 0)
        return F.struct(now.alias("depth"), at.alias("at"), F.when(closed, at).otherwise(a["end"]).alias("end"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pieces), F.lit(0)), start, step, lambda a: a["end"])


def balanced_end(text: Column, start: Column) -> Column:
    """The offset just behind the bracket that closes the one at `start` (from 0), whatever kinds the two are of; brackets in
    quoted strings don't count. -1 if it stays open, null for null."""
    rest = F.substring(text, start + 1, F.length(text))
    return F.when(text.isNotNull() & start.isNotNull(), F.coalesce(_end(rest, BRACKETS, 0) + start, F.lit(-1)))


def macros(text: Column) -> Column:
    """Array of (name, value) of the macros that a text defines, in their order; a value may hold balanced braces, and further
    definitions. The value of a macro that stays open is null. Null for a null text."""
    names = F.regexp_extract_all(text, F.lit(HEAD), F.lit(1))
    heads = F.regexp_extract_all(text, F.lit(HEAD), F.lit(0))
    after = F.slice(F.split(text, HEAD, -1), 2, F.size(names))
    tail = lambda i: F.array_join(F.flatten(F.zip_with(F.slice(after, i + 1, F.size(after)), F.slice(F.concat(heads, F.array(F.lit(""))), i + 2, F.size(after)), lambda a, h: F.array(a, h))), "")

    def value(piece: Column, i: Column) -> Column:
        own = _end(piece, BRACES, 1)
        # only a value that holds another definition needs what follows
        whole = F.when(own.isNotNull(), piece).otherwise(tail(i))
        end = F.coalesce(own, _end(whole, BRACES, 1))
        return F.struct(names[i].alias("name"), F.substring(whole, F.lit(1), end - 1).alias("value"))

    return F.transform(after, value)
