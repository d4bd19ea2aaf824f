"""Sheets for a review by hand: several sources of different grain in one ordered text a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relate import carry_forward
from .text import line_rows

# Files whose changes are the task itself, and so are left out of a sheet.
MANIFESTS = ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt")


def code_excerpt(patches: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, excerpt): the first lines of a patch without the sections of manifests; lines before the first section are left
    out. Null where nothing is left."""
    rows = line_rows(patches.where(F.col(text).isNotNull()), key, text)
    opens = F.when(F.col("line").startswith("diff --git"), ~F.col("line").rlike(f"({'|'.join(m.replace('.', '[.]') for m in MANIFESTS)})$"))
    kept = carry_forward(rows, key, "line_no", opens, "keep").where("keep")
    # the first lines of each patch: a bounded list a key
    lines = F.slice(F.array_sort(F.collect_list(F.struct("line_no", "line"))), 1, most)
    return kept.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("excerpt"))


def review_sheet(attempts: DataFrame, flags: list[str], patches: DataFrame, turns: DataFrame, key: str, patch: str, conversation: str, turn: str, role: str, said: str, lines: int = 120, letters: int = 400) -> DataFrame:
    """(key, sheet): for each row of attempts(key, flags...) a heading, its flags, the beginning of what the agent said last in
    turns, a space for the verdict, and the changes outside of manifests from patches(key, patch). turns(conversation, turn,
    role, said) has the agent's words under the role 'assistant'. Null flags are shown as '-'; missing patches and
    conversations leave their places empty."""
    spoken = turns.where((F.col(role) == "assistant") & F.col(said).isNotNull()).groupBy(F.col(conversation).alias(key)).agg(F.max_by(said, turn).alias("__said"))
    both = attempts.select(key, *flags).join(code_excerpt(patches, key, patch, lines), key, "left").join(spoken, key, "left")
    shown = F.concat_ws(" | ", *[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("-"))) for f in flags])
    parts = [
        F.concat(F.lit("## "), F.col(key).cast("string")),
        shown,
        F.concat(F.lit("Said last: "), F.coalesce(F.left("__said", F.lit(letters)), F.lit(""))),
        F.lit("Verdict: ____________"),
        F.concat(F.lit("```diff\n"), F.coalesce("excerpt", F.lit("(no changes outside of manifests)")), F.lit("\n```")),
    ]
    return both.select(key, F.concat_ws("\n\n", *parts).alias("sheet"))
