"""Text and diff operators: line tables, unified diffs, marker audits, context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import lines
from .relate import carry_forward


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), from 0."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def diff_lines(patches: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, hunk, body, section, old, new) of every line of unified diffs. body tells whether the line
    belongs to a hunk, which its header's counts decide: a removed line `-- x` is no file header, whatever it looks like. In
    a diff without hunk headers all lines that begin with a sign or a space, but for file headers, form one hunk (null).
    section is the number of the file's first header line."""
    line = F.col("line")
    rows = carry_forward(line_rows(patches, key, text), key, "line_no", F.when(line.rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"), F.col("line_no")), "hunk")
    count = lambda side: F.when(F.col("line_no") == F.col("hunk"), F.coalesce(F.nullif(F.regexp_extract("line", rf"^@@ .*?\{side}\d+,(\d+)", 1), F.lit("")), F.lit("1")).cast("long"))
    so_far = Window.partitionBy(key, "hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(key, "hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("line_no") > F.col("hunk")
    takes = lambda sign: F.sum((inside & (line.startswith(sign) | line.startswith(" ") | (line == ""))).cast("long")).over(so_far)
    rows = rows.withColumns({"left_old": F.first(count("-")).over(first) - F.coalesce(takes("-"), F.lit(0)), "left_new": F.first(count("+")).over(first) - F.coalesce(takes("+"), F.lit(0))})
    signed = line.rlike(r"^[+ -]") | (line == "")
    plain = line.rlike(r"^[+ -]") & ~line.rlike(r"^(--- |\+\+\+ )")
    counted = signed & ((F.col("left_old") > 0) | (F.col("left_new") > 0))
    body = F.when(F.col("hunk").isNull(), plain).otherwise(inside & (counted | plain))  # a hunk may hold more than it says
    rows = rows.withColumn("body", body).drop("left_old", "left_new")
    outside = ~F.col("body")
    opens = F.when(outside & line.startswith("diff --git "), F.col("line_no"))
    opens = F.coalesce(opens, F.when(outside & line.startswith("--- "), F.col("line_no")))
    before = F.lag(outside & line.rlike(r"^(diff --git |index |new file|deleted file|old mode|new mode|similarity |rename )")).over(Window.partitionBy(key).orderBy("line_no"))
    rows = carry_forward(rows.withColumn("in_header", F.coalesce(before, F.lit(False))), key, "line_no", F.when(line.startswith("--- ") & F.col("in_header"), F.lit(None)).otherwise(opens), "section")
    path = lambda sign, side: F.when(outside & line.startswith(sign), F.regexp_replace(F.regexp_replace(line, rf"^\{sign[0]}{{3}} ({side}/)?", ""), r"\t.*$", ""))
    rows = carry_forward(carry_forward(rows, key, "line_no", path("--- ", "a"), "old"), key, "line_no", path("+++ ", "b"), "new")
    return rows.drop("in_header")


def path_of() -> Column:
    """The path of a diff_lines() row; deleted files keep their old one."""
    return F.when(F.col("new") == "/dev/null", F.col("old")).otherwise(F.col("new"))


def diff_rows(patches: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, hunk, line_no, kind, text) of the lines in hunks; kind is add, del or ctx. Deleted files keep their old
    path."""
    line = F.col("line")
    kind = F.when(line.startswith("+"), "add").when(line.startswith("-"), "del").otherwise("ctx")
    return diff_lines(patches, key, text).where("body").select(key, path_of().alias("path"), "hunk", "line_no", kind.alias("kind"), F.substring(line, 2, 1 << 30).alias("text"))


def diff_summary(patches: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, added, deleted)."""
    return file_changes(patches, key, text).select(key, "path", "added", "deleted")


def file_changes(patches: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, added, deleted, new_file, deleted_file)."""
    line = F.col("line")
    rows = diff_lines(patches, key, text).where(F.col("new").isNotNull() & (F.col("body") | line.startswith("+++ "))).withColumn("path", path_of())
    return rows.groupBy(key, "path").agg(
        F.count_if(F.col("body") & line.startswith("+")).alias("added"),
        F.count_if(F.col("body") & line.startswith("-")).alias("deleted"),
        F.bool_or(F.col("old") == "/dev/null").alias("new_file"),
        F.bool_or(F.col("new") == "/dev/null").alias("deleted_file"),
    )


def added_text(patches: DataFrame, key: str, text: str, suffix: str = ".py") -> DataFrame:
    """(key, path, change, text): the added lines of each file whose name ends so; a new file's are its whole content.
    Deleted files and files without added lines are left out."""
    rows = diff_lines(patches, key, text).withColumn("path", path_of()).where(F.col("path").endswith(suffix) & (F.col("new") != "/dev/null") & F.col("body") & F.col("line").startswith("+"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.substring("line", 2, 1 << 30).alias("t"))))  # one file of one patch
    change = F.when(F.bool_or(F.col("old") == "/dev/null"), "added").otherwise("modified")
    return rows.groupBy(key, "path").agg(change.alias("change"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def elided_digest(patches: DataFrame, key: str, text: str, injected: list[str]) -> DataFrame:
    """(key, digest): SHA-1 of the patch without the sections of files of these names, so that patches that differ only in
    what a harness injected are equal. A patch of nothing else has the digest of the empty text."""
    rows = diff_lines(patches, key, text)
    named = F.element_at(F.split(F.regexp_replace("line", r"^diff --git .* b/", ""), "/"), -1).isin(injected)
    drop = carry_forward(rows, key, "line_no", F.when(~F.col("body") & F.col("line").startswith("diff --git "), named), "drop")
    kept = drop.where(~F.coalesce("drop", F.lit(False)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")  # one patch
    found = kept.groupBy(key).agg(F.sha1(whole).alias("digest"))
    return patches.select(key).distinct().join(found, key, "left").select(key, F.coalesce("digest", F.sha1(F.lit(""))).alias("digest"))


def matched_line_ends(patches: DataFrame, key: str, text: str, crlf_paths: DataFrame) -> DataFrame:
    """(key, text): hunk lines of files in crlf_paths(key, path) end in CR LF, other lines as they are."""
    # a patch comes together where its lines already are, and only then meets its paths: lines are shuffled once
    line = F.struct("line_no", "line", F.when(F.col("body"), path_of()).alias("path"))
    whole = diff_lines(patches, key, text).groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"))  # one patch
    paths = crlf_paths.where(F.col("path").isNotNull()).groupBy(key).agg(F.collect_set("path").alias("crlf"))
    ends = lambda x, crlf: F.when(F.array_contains(crlf, x["path"]), F.concat(F.rtrim(x["line"], F.lit("\r")), F.lit("\r"))).otherwise(x["line"])
    both = whole.join(paths, key, "left").select(key, "lines", F.coalesce("crlf", F.expr("cast(array() AS array<string>)")).alias("crlf"))
    return both.select(key, F.array_join(F.transform("lines", lambda x: ends(x, F.col("crlf"))), "\n").alias("text"))


def marker_audit(docs: DataFrame, group: Column, text: str, required: list[str], forbidden: list[str]) -> DataFrame:
    """By group: rows, rows that lack a required marker, rows that hold a forbidden one."""
    has = lambda m: F.col(text).contains(m)
    lacks = sum((~has(m)).cast("int") for m in required) > 0 if required else F.lit(False)
    holds = sum(has(m).cast("int") for m in forbidden) > 0 if forbidden else F.lit(False)
    return docs.groupBy(group.alias("group")).agg(F.count("*").alias("n"), F.count_if(lacks).alias("lacking"), F.count_if(holds).alias("forbidden"))


def inferred_kind(files: DataFrame, key: str, order: str, text: str, kinds: list[tuple[str, str]], first: int = 5) -> DataFrame:
    """(key, kind): the first kind, of (kind, marker), whose marker one of the key's first files holds; else 'none'."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    some = files.select(key, text, nth.alias("nth")).where(F.col("nth") <= first)
    label = F.lit("none")
    for name, marker in reversed(kinds):
        label = F.when(F.bool_or(F.col(text).contains(marker)), name).otherwise(label)
    return some.groupBy(key).agg(label.alias("kind"))


def context_window(rows: DataFrame, key: str, order: str, hit: Column, before: int) -> DataFrame:
    """Up to `before` rows ahead of a key's first hit, with the hit; of a key without one its last `before` rows."""
    whole = Window.partitionBy(key)
    first = F.min(F.when(hit, F.col(order))).over(whole)
    at = F.row_number().over(whole.orderBy(order))
    rows = rows.withColumns({"__first": first, "__at": at}).withColumns({"__hit": F.min(F.when(F.col(order) == F.col("__first"), F.col("__at"))).over(whole), "__n": F.count("*").over(whole)})
    low, high = F.coalesce(F.col("__hit") - before, F.col("__n") - before + 1), F.coalesce("__hit", "__n")
    return rows.where((F.col("__at") >= low) & (F.col("__at") <= high)).drop("__first", "__at", "__hit", "__n")
