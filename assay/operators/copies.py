"""Copy detection by winnowed fingerprints, inside the row or as windows over token rows: values only, positions dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import code_tokens
from ..functions.names import words
from .graph import to_all


def token_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(words(F.lower(text))).alias("at", "token"))


def code_token_rows(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, at, token) of source files: strings, numbers and names are placeholders."""
    return files.select(*keys, F.posexplode(code_tokens(F.col(text))).alias("at", "token"))


def library_prints(prints: DataFrame) -> DataFrame:
    """(print): what a whole library has, each once."""
    return prints.select("print").distinct()


def library_containment(prints: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """(key, prints, containment): the share of a candidate's prints that a library has. The library has a print once, so
    a print that everyone has makes no pairs; its rows are split like any skewed join's."""
    marked = prints.join(library_prints(library).withColumn("in_library", F.lit(1)), "print", "left")
    return marked.groupBy(key).agg(F.count("*").alias("prints"), (F.count("in_library") / F.count("*")).alias("containment"))


def winnow(tokens: DataFrame, key: str, k: int, w: int, digest=F.crc32) -> DataFrame:
    """(key, print): the smallest digest of each w consecutive k-grams; all of them if there are no more than w."""
    order = Window.partitionBy(key).orderBy("at")
    gram = F.collect_list("token").over(order.rowsBetween(0, k - 1))
    grams = tokens.withColumn("gram", gram).where(F.size("gram") == k).select(key, "at", digest(F.array_join("gram", " ")).alias("h"))
    ahead = order.rowsBetween(0, w - 1)
    low = grams.withColumn("low", F.min("h").over(ahead)).withColumn("held", F.count("*").over(ahead)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return low.select(key, F.when(F.col("n") <= w, F.col("h")).when(F.col("held") == w, F.col("low")).alias("print")).where("print IS NOT NULL").distinct()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_prints(tokens: Column, k: int, w: int, digest=F.crc32) -> Column:
    """The prints of winnow(), each once, of a row's array of tokens: nothing is shuffled."""
    runs = lambda u, m, f: F.transform(F.sequence(F.lit(1), F.size(u) - (m - 1)), lambda i: f(F.slice(u, i, m)))
    grams = lambda u: F.when(F.size(u) >= k, runs(u, k, lambda g: digest(F.array_join(g, " "))))
    low = lambda h: F.array_distinct(F.when(F.size(h) <= w, h).otherwise(runs(h, w, F.array_min)))
    return _let(tokens, lambda u: _let(grams(u), low))


def code_prints(source: Column, k: int, w: int, digest=F.crc32) -> Column:
    """(tokens, prints) of a row's source text: the number of its tokens, and their prints."""
    return _let(code_tokens(source), lambda u: F.struct(F.size(u).cast("long").alias("tokens"), row_prints(u, k, w, digest).alias("prints")))


def row_containment(rows: DataFrame, library: DataFrame, key: str, library_key: str) -> DataFrame:
    """containment() of rows(key, prints) and library(library_key, prints), whose prints are arrays; keys are unique."""
    known = to_all(library.select(library_key, F.explode("prints").alias("print")).distinct())
    # explode() would make the prints once more, for a filter on their number
    each = rows.select(key, F.explode_outer(_let(F.col("prints"), lambda h: F.transform(h, lambda p: F.struct(F.size(h).alias("n"), p.alias("print"))))).alias("x"))
    met = each.select(key, "x.n", "x.print").where(F.col(key).isNotNull()).join(known, "print")
    shared = met.groupBy(key, library_key, "n").agg(F.count("*").alias("shared"))
    return shared.select(key, library_key, "shared", (F.col("shared") / F.col("n")).alias("containment"))


def row_library_containment(rows: DataFrame, library: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, more, containment) of rows(key, more, prints) in library(prints): the share of a row's prints that the library
    has, 0 without any print. Keys are unique, and more is theirs."""
    known = to_all(library.select(F.explode("prints").alias("print")).distinct()).withColumn("in_library", F.lit(1))
    each = rows.select(key, *more, F.explode_outer("prints").alias("print")).join(known, "print", "left")
    share = F.when(F.col(key).isNotNull(), F.count("in_library") / F.nullif(F.count("print"), F.lit(0)))
    return each.groupBy(key, *more).agg(F.coalesce(share, F.lit(0.0)).alias("containment"))


def containment(prints: DataFrame, library: DataFrame, key: str, library_key: str) -> DataFrame:
    """(key, library_key, shared, containment): the share of a candidate's prints that a library item has."""
    n = prints.groupBy(key).agg(F.count("*").alias("prints"))
    shared = prints.join(library, "print").groupBy(key, library_key).agg(F.count("*").alias("shared"))
    return shared.join(n, key).select(key, library_key, "shared", (F.col("shared") / F.col("prints")).alias("containment"))


def copy_gate(tokens: Column, share: Column, least_tokens: int = 60, limit: float = 0.6) -> Column:
    """Small files aren't scored and pass; null if there is nothing to compare with."""
    return F.when(tokens < least_tokens, True).when(share.isNotNull(), share < limit)
