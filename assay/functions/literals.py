"""Python literals of recorded values: typed text out of a VARIANT, and wrong values of the right type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# By type, the literals tried as a wrong value, in this order, with the recorded value that each would equal
# (as JSON text; null for containers, which equal any empty one).
CANDIDATES = (
    ("int", "0", "0"), ("int", "-1", "-1"), ("int", "1", "1"),
    ("float", "0.0", "0.0"), ("float", "-1.0", "-1.0"),
    ("bool", "False", "false"), ("bool", "True", "true"),
    ("str", "''", ""), ("str", "'x'", "x"),
    ("bytes", "b''", ""), ("bytes", "b'x'", "x"), ("bytearray", "bytearray()", ""),
    ("list", "[]", None), ("list", "[None]", None), ("tuple", "()", None), ("tuple", "(None,)", None),
    ("dict", "{}", None), ("dict", "{'x': None}", None), ("set", "set()", None), ("frozenset", "frozenset()", None),
)
EMPTY = ("[]", "()", "{}", "set()", "frozenset()")


def quoted(text: Column) -> Column:
    """A string as a Python literal."""
    for raw, escape in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\x00")):
        text = F.replace(text, F.lit(raw), F.lit(escape))
    return F.concat(F.lit("'"), text, F.lit("'"))


def literal(json: Column, depth: int = 3) -> Column:
    """The Python expression of a recorded value (JSON). Null where a part of it is a live object, or lies deeper than `depth`
    containers, or has a kind that can't be written down. Plain JSON stands for itself."""
    return _literal(F.try_parse_json(json), depth)


def _literal(v: Column, depth: int) -> Column:
    get = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    kind, value = get("t"), get("v")
    number = F.when(F.lower(value).isin("nan", "inf", "-inf", "infinity", "-infinity"), F.concat(F.lit("float('"), F.lower(value), F.lit("')"))).otherwise(F.when(value.rlike(r"[.eE]"), value).otherwise(F.concat(value, F.lit(".0"))))
    hexed = F.regexp_replace(F.lower(F.hex(F.encode(F.coalesce(value, F.lit("")), "UTF-8"))), "(..)", r"\\x$1")
    data = F.concat(F.lit("b'"), hexed, F.lit("'"))
    plain = F.schema_of_variant(v)
    bare = F.when(plain == "VOID", "None").when(plain == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).when(plain == "STRING", quoted(F.try_variant_get(v, "$", "string"))).when(~plain.startswith("ARRAY"), F.try_variant_get(v, "$", "string"))
    if depth:
        items = F.coalesce(get("items", "array<variant>"), F.array().cast("array<variant>"))
        in_dict = kind == "dict"
        key = lambda i: F.when(in_dict, F.concat(_literal(F.try_variant_get(i, "$[0]", "variant"), 0), F.lit(": "))).otherwise("")
        parts = F.transform(items, lambda i: F.concat(key(i), _literal(F.when(in_dict, F.try_variant_get(i, "$[1]", "variant")).otherwise(i), depth - 1)))
        opens = F.when(kind == "list", "[").when(kind == "tuple", "(").when(in_dict | (kind == "set"), "{").when(kind == "frozenset", "frozenset({")
        closes = F.when(kind == "list", "]").when(kind == "tuple", F.when(F.size(items) == 1, ",)").otherwise(")")).when(in_dict | (kind == "set"), "}").when(kind == "frozenset", "})")
        # join() would skip what can't be written down; the fold is null then
        body = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit("").alias("text")), lambda a, x: F.struct((a["n"] + 1).alias("n"), F.concat(a["text"], F.when(a["n"] > 0, ", ").otherwise(""), x).alias("text")), lambda a: a["text"])
        container = F.when((F.size(items) == 0) & kind.isin("set", "frozenset"), F.concat(kind, F.lit("()"))).otherwise(F.concat(opens, body, closes))
    else:
        container = F.lit(None).cast("string")
    typed = (
        F.when(kind == "str", quoted(F.coalesce(value, F.lit("")))).when(kind == "int", F.coalesce(value, F.lit("0"))).when(kind == "float", F.coalesce(number, F.lit("0.0")))
        .when(kind == "bool", F.initcap(value)).when(kind == "NoneType", "None").when(kind == "bytes", data).when(kind == "bytearray", F.concat(F.lit("bytearray("), data, F.lit(")")))
        .otherwise(container)
    )
    return F.when(plain.startswith("OBJECT"), typed).otherwise(bare)


def wrong_values(calls: DataFrame, key: str, value: str) -> DataFrame:
    """(key, literal): for each key of calls(key, value), a value of the type that all its recorded values have, and that
    differs from every one of them: the first of CANDIDATES that none equals. literal is null where types vary, are None's
    or unknown, where nothing typed was recorded, or where each candidate was returned.

    Numbers are compared as numbers and bytes by their content; a container's candidate equals any empty one."""
    v = F.try_parse_json(value)
    rows = calls.select(key, F.try_variant_get(v, "$.t", "string").alias("t"), F.try_variant_get(v, "$.v", "string").alias("v"), (F.size(F.coalesce(F.try_variant_get(v, "$.items", "array<variant>"), F.array().cast("array<variant>"))) == 0).alias("empty")).where("t IS NOT NULL")
    seen = rows.distinct()  # few values a key, in most cases
    one = seen.groupBy(key).agg(F.min("t").alias("t"), (F.min("t") == F.max("t")).alias("same"))
    table = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(t).alias("t"), F.lit(c).alias("literal"), F.lit(e).cast("string").alias("equals")) for i, (t, c, e) in enumerate(CANDIDATES)])
    tried = one.where("same").select(key, F.explode(F.filter(table, lambda c: c["t"] == F.col("t"))).alias("c")).select(key, "c.*")
    met = tried.join(seen.select(key, "v", "empty"), key)
    equal = F.when(F.col("equals").isNull(), F.col("empty") & F.col("literal").isin(*EMPTY)).when(F.col("t").isin("int", "float"), F.expr("try_cast(v AS double) = try_cast(equals AS double)")).otherwise(F.col("v") == F.col("equals"))
    hit = met.where(equal).select(key, "nth").distinct()
    free = tried.join(hit, [key, "nth"], "left_anti").groupBy(key).agg(F.min_by("literal", "nth").alias("literal"))
    return calls.select(key).distinct().join(free, key, "left")


def held_against(fakes: DataFrame, calls: DataFrame, key: str, fake: str, value: str) -> DataFrame:
    """(key, n, comparable, equal, convincing): against how many recorded values a fake literal was held, how many of these can
    be written down, how many it equals. It convinces if some can, and it equals none."""
    both = fakes.select(key, F.col(fake).alias("f")).join(calls.select(key, F.col(value).alias("j"), literal(F.col(value)).alias("r")), key, "left")
    n = both.groupBy(key).agg(F.count("j").alias("n"), F.count("r").alias("comparable"), F.count_if(F.col("f") == F.col("r")).alias("equal"))
    return n.withColumn("convincing", (F.col("comparable") > 0) & (F.col("equal") == 0))
