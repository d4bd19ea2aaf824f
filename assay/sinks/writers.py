"""Summaries beside rows, appended JSON lines, CSV, one folder a key, and tables as text for small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary_and_rows(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """Two JSON folders, <path>/summary and <path>/rows; each is replaced as a whole."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A header and the columns in the order given; a missing one is null."""
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*have).write.mode("overwrite").option("header", True).csv(path)


def folder_per_key(rows: DataFrame, path: str, keys: list[str]) -> None:
    """<path>/<key>=<value>/...; rows of one key come from as many tasks as hold them, so a hot key isn't one task."""
    rows.write.mode("overwrite").partitionBy(*keys).json(path)


def _cells(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]


def markdown_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(nth, line) of a table in Markdown; bars in values are escaped. For results of a few rows: they are numbered in one
    window."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.orderBy(*order)) + 1
    body = rows.select(nth.alias("nth"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(c, F.lit("|"), F.lit("\\|")) for c in _cells(columns)]), F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, f"|{'-|' * len(columns)}")], "nth int, line string")
    return head.unionByName(body)


def fixed_width_lines(rows: DataFrame, widths: dict[str, int], order: list[str]) -> DataFrame:
    """(nth, line) with columns of fixed widths, numbers to the right; longer values are kept whole."""
    from pyspark.sql import Window

    def cell(c: str, n: int) -> Column:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        pad = F.lpad if dict(rows.dtypes)[c] not in ("string", "boolean") else F.rpad
        return F.when(F.length(text) >= n, text).otherwise(pad(text, n, " "))

    nth = F.row_number().over(Window.orderBy(*order))
    return rows.select(nth.alias("nth"), F.concat_ws(" ", *[cell(c, n) for c, n in widths.items()]).alias("line"))
