"""Mutants of Python sources: a table function with one row for each mutation site and operator, called laterally.

A mutant is the source text with one stretch replaced, so layout and comments stay, and each mutant differs at one place.
Sites that begin at one place (`a and b or c` holds two) are sites of their own. Mutants that don't compile, or equal the
source, are left out. A null source, or one that doesn't parse, has no mutants.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Comparisons and what each becomes.
SWAPS = {ast.Lt: ast.LtE, ast.LtE: ast.Lt, ast.Gt: ast.GtE, ast.GtE: ast.Gt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.In: ast.NotIn, ast.NotIn: ast.In, ast.Is: ast.IsNot, ast.IsNot: ast.Is}
#: The operators' names, as they stand in the column `operator`.
OPERATORS = ("comparison", "boundary+1", "boundary-1", "branch", "constant return", "negation dropped", "and/or swapped", "call dropped", "container emptied")
_TIGHT = (ast.Name, ast.Attribute, ast.Subscript, ast.Call, ast.List, ast.Dict, ast.Set, ast.ListComp, ast.Starred)


def _within(node: ast.expr) -> str:
    """An expression's text that binds as tightly as what it stands in for."""
    text = ast.unparse(node)
    tight = isinstance(node, _TIGHT) or isinstance(node, ast.Constant) and not text.startswith("-")
    return text if tight else f"({text})"


def _edits(node: ast.AST) -> Iterator[tuple[str, str, ast.AST, ast.AST]]:
    """(operator, new text, first node, last node of the stretch that it replaces) for the sites at a node."""
    whole = lambda op, new: (op, new, node, node)
    match node:
        case ast.Compare():
            for i, op in enumerate(node.ops):
                if type(op) in SWAPS:
                    ops = [SWAPS[type(op)]() if j == i else o for j, o in enumerate(node.ops)]
                    yield whole("comparison", ast.unparse(ast.Compare(node.left, ops, node.comparators)))
        case ast.Constant(value=bool()):
            pass
        case ast.Constant(value=int(v)):
            yield whole("boundary+1", str(v + 1))
            yield whole("boundary-1", str(v - 1) if v else "(-1)")
        case ast.If():
            yield "branch", "pass", node.body[0], node.body[-1]
        case ast.Return(value=value) if value is not None and not (isinstance(value, ast.Constant) and value.value is None):
            yield whole("constant return", "return 0")
        case ast.UnaryOp(op=ast.Not()):
            yield whole("negation dropped", _within(node.operand))
        case ast.BoolOp():
            op = ast.Or() if isinstance(node.op, ast.And) else ast.And()
            yield whole("and/or swapped", f"({ast.unparse(ast.BoolOp(op, node.values))})")
        case ast.Call(args=[one], keywords=[]):
            yield whole("call dropped", _within(one))
        case ast.List(elts=[_, *_], ctx=ast.Load()):
            yield whole("container emptied", "[]")
        case ast.Set(elts=[_, *_]):
            yield whole("container emptied", "set()")
        case ast.Dict(keys=[_, *_]):
            yield whole("container emptied", "{}")


def _compiled(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "mutant", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def mutants_of(source: str | None) -> Iterator[tuple[str, int, int, str]]:
    """(operator, line, column, text) of each mutant of one source; column counts UTF-8 bytes."""
    try:
        tree = ast.parse(source or "")
        lines = (source or "").encode().splitlines(keepends=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    data = b"".join(lines)
    for node in ast.walk(tree):
        for operator, new, first, last in _edits(node):
            row = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
            col = min([first.col_offset, *(d.col_offset - 1 for d in getattr(first, "decorator_list", []))])
            a, b = starts[row - 1] + col, starts[last.end_lineno - 1] + last.end_col_offset
            try:
                text = (data[:a] + new.encode() + data[b:]).decode()
            except UnicodeError:
                continue
            if text != source and _compiled(text):
                yield operator, node.lineno, node.col_offset, text


@udtf(returnType="operator string, line int, col int, mutant string")
class Mutants:
    def eval(self, source: str):
        yield from mutants_of(source)


def mutants(sources: DataFrame, text: str) -> DataFrame:
    """sources, each row beside each of its mutants (operator, line, col, mutant); sources without mutants have no row."""
    return sources.lateralJoin(Mutants(F.col(f"`{text}`").outer()))


def killed(mutated: DataFrame, baseline: DataFrame, key: list[str], passed: Column, baseline_passed: Column) -> DataFrame:
    """(key, mutants, killed, survived, status): how many of a key's mutants its tests notice. mutated has a row a mutant, whose
    tests passed, failed or (null) didn't end; those count as neither.

    The unchanged code must pass its tests, or nothing is said: status is unverified where baseline has no row for the key,
    or one that didn't pass; 'fail' where mutants were run and none was noticed, 'pass' otherwise."""
    n = mutated.groupBy(*key).agg(F.count("*").alias("mutants"), F.count_if(~passed).alias("killed"), F.count_if(passed).alias("survived"))
    sound = baseline.groupBy(*key).agg(F.bool_and(F.coalesce(baseline_passed, F.lit(False))).alias("sound"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("mutants", "killed", "survived")]
    status = F.when(~F.coalesce("sound", F.lit(False)), "unverified").when((F.col("survived") > 0) & (F.col("killed") == 0), "fail").otherwise("pass")
    return sound.join(n, key, "full").select(*key, *counts, status.alias("status"))
