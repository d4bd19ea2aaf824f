"""Renamed copies of source texts: each name becomes v0, v1, ... by its first occurrence, so that structure stays and words go."""

from __future__ import annotations

import keyword

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import TOKEN

#: Tokens and the white space between them, so that all pieces together are the text.
PIECE = TOKEN + r"|\n|[^\S\n]+|[\p{L}\p{N}_]"
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


def _base36(n: int) -> str:
    return (_base36(n // 36) if n >= 36 else "") + _DIGITS[n % 36]


def renamed_pieces(pieces: list[str]) -> str:
    """The renamed copy of a text that is cut into pieces: one pass that knows the depth of brackets, the last token that
    isn't a comment, and whether a line has ended since."""
    names: dict[str, str] = {}
    out, depth, last, ended = [], 0, None, False
    for p in pieces:
        begin = p[0]
        space = begin in " \t\n\x0b\f\r"
        if begin == "#":
            out.append("")
            continue
        if len(p) > 1 and ("'" in p or '"' in p):
            out.append("0" if last is None or ended else p)
        elif begin in _NAME and not keyword.iskeyword(p):
            out.append(names.setdefault(p, "v" + _base36(len(names))))
        else:
            out.append(p)
        if p == "\n" and depth <= 0 and last != "\\":
            ended = True
        elif not space:
            depth += (p in ("(", "[", "{")) - (p in (")", "]", "}"))
            last, ended = p, False
    return "".join(out)


def renamed(files: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, renamed) of source texts: names become v and their place of first occurrence in base 36, comments go, and a
    string that begins a statement becomes 0. Keywords, other strings, signs and white space stay.

    Row by row, without a shuffle; repeated keys stay, each with names of its own. Null texts are left out."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return files.where(F.col(text).isNotNull()).select(*key, F.udf(renamed_pieces, "string", useArrow=True)(pieces).alias("renamed"))
