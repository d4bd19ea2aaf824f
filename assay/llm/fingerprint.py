"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, in DataFrame and SQL functions only.

A text is a set of paragraphs: its lines, cut at every sentence end; what is still longer than `longest` is cut after
words whose hash, with the word before, meets a condition. A place thus depends on nothing but the text around it. A
paragraph's digest is a 64-bit number that also holds its length (15 bits, or 31 for the few that need them), so what
peeling recovers also tells how much text differs. A sketch has 3 x 8 cells of
(count, xor of digests, xor of their hashes). Two sketches are subtracted cell by cell and peeled: a cell with one digest
gives it up, which empties others. Where peeling gets stuck, the pair's digests are dealt, by ranges of their hash, into small
sketches of DEALT digests each, and those of the sketches that fail are dealt again with another hash, until all of them
peel. All of that happens inside the row, so that only texts are shuffled, once. Work grows with the digests: Spark
interprets functions of arrays and copies what transform() and aggregate() give deeply, so cells and digests are plain numbers
where they are many.

The likeness of two fingerprints is the length of shared paragraphs over that of all different ones; 1 for two empty
texts. It depends on the sets only, not on how often peeling was retried.

Null text is the empty text. Repeated paragraphs of a text count once. Repeated rows and ids are kept; rows of one id
follow each other by their text's hash, null ids come first. An empty table gives an empty result. Rows with a common id
share one window partition, so ids should be nearly unique. Other columns play no part in edited_likeness() and may have any
name; fingerprints() replaces a column `fingerprint`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

LONG_LINE = 400
#: Sentences longer than this are cut on in the query, after one word of CUT_EVERY on average.
LONG_PIECE = 120
CUT_EVERY = 8
SENTENCE_END = r"\n+|(?=\s)(?<=[.!?…])\s+|(?<=[。！？])"
_SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_LETTER = rf"[^\s{_SPACELESS}]"
#: Words with the white space behind them; characters of scripts without spaces, and of runs of over 64, stand alone. Words
#: of ASCII come first because a character's script is slow to look up.
UNIT = rf"[!-~]{{1,64}}+(?!{_LETTER})\s*+|{_LETTER}{{1,64}}+(?!{_LETTER})\s*+|\S\s*+|\s++"
#: The longest beginning of a text that ends with a sentence end behind which a sentence starts, whatever comes after it.
HEAD = r"(?s)\A(.*(?:\n|[.!?…][ \t]+|[。！？]))(?=\S)"
SIDE = 8
WAYS = 3
#: Sets whose sketch doesn't peel are dealt into sketches of DEALT digests and WAYS x DEALT_SIDE cells.
DEALT = 4
DEALT_SIDE = 4
MAX_LEVELS = 24


def let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once. The last step of aggregate() copies nothing, transform()
    would copy what body gives, deeply."""
    return f"aggregate(array(), {value}, ({name}, _) -> {name}, {name} -> {body})"


def _digest(p: str) -> str:
    """SQL: the digest of a paragraph."""
    # lengths from 2^15 on are flagged, with their higher bits in bits 16 to 31
    n = f"cast(length({p}) AS bigint)"
    return f"if(length({p}) < 32768, (xxhash64({p}) & -65536L) | {n}, (xxhash64({p}) & -4294967296L) | shiftleft(shiftright({n}, 15), 16) | 32768L | ({n} & 32767L))"


def _cut_on(p: str) -> str:
    """SQL: the digests of a sentence cut at content-defined places, as an array."""
    at = f"filter(slice(sequence(0, size(u) - 1), 2, greatest(size(u) - 2, 0)), i -> (xxhash64(concat(u[i - 1], u[i])) & {CUT_EVERY - 1}) = 0)"
    last = f"concat(if(size(u) > 1 AND (xxhash64(u[0]) & {CUT_EVERY - 1}) = 0, array(0), slice(array(0), 1, 0)), {at}, array(size(u) - 1))"
    part = "array_join(slice(u, if(k = 0, 0, last[k - 1] + 1) + 1, z - if(k = 0, -1, last[k - 1])), '')"
    return let("u", f"regexp_extract_all({p}, r'{UNIT}', 0)", let("last", last, f"transform(last, (z, k) -> {let('q', part, _digest('q'))})"))


def _digests(text: str, longest: int) -> str:
    """SQL: the paragraph digests of a text column in order, with repeats."""
    sentences = f"filter(split({text}, r'{SENTENCE_END}'), p -> p <> '')"
    return f"flatten(transform({sentences}, p -> if(length(p) > {longest}, {_cut_on('p')}, array({_digest('p')}))))"


def digests(text: str, longest: int = 2 * LONG_LINE) -> str:
    """SQL: the set of paragraph digests of a text column, as an array."""
    return f"array_distinct({_digests(text, longest)})"


def length_of(d: str) -> str:
    """SQL: the length that a digest holds."""
    return f"(({d} & 32767L) + if(({d} & 32768L) = 0L, 0L, shiftleft(shiftright({d}, 16) & 65535L, 15)))"


def weight(d: str) -> str:
    return f"aggregate({d}, 0L, (w, d) -> w + {length_of('d')})"


def _hash(d: str, level: int | str) -> str:
    return f"xxhash64({d}, {level})"


def _mask(h: str) -> str:
    """SQL: the three cells of hash h, as bits."""
    return "(" + " | ".join(f"shiftleft(1, cast({w * SIDE} + (shiftright({h}, {3 * w}) & {SIDE - 1}) AS int))" for w in range(WAYS)) + ")"


def sketch(d: str, level: int) -> str:
    """SQL: the cells of a digest set."""
    cell = "transform(sequence(0L, {}L), b -> {})"
    xor = "if(size(in_) = 0, 0L, aggregate(in_, 0L, (a, d) -> a ^ {}))"
    found = let("in_", "filter(ds, (d, i) -> (shiftright(hs[i], {}) & {}L) = b)", f"struct(size(in_) AS c, {xor.format('d')} AS k, {xor.format(_hash('d', level))} AS h)")
    cells = f"concat({', '.join(cell.format(SIDE - 1, found.format(3 * w, SIDE - 1)) for w in range(WAYS))})"
    return let("ds", d, let("hs", f"transform(ds, d -> {_hash('d', level)})", cells))


def peel(cells: str, level: int | str, rounds: int = 16) -> str:
    """SQL: (ok, w): whether all cells emptied, and the length of the paragraphs they gave up. Rounds without a cell of one
    digest end it."""
    pure = f"transform(array_distinct(filter(acc.cells, c -> abs(c.c) = 1 AND {_hash('c.k', level)} = c.h)), c -> struct(c.c AS c, c.k AS k, c.h AS h, {_mask('c.h')} AS m))"
    less = "aggregate(pure, c, (u, p) -> if((p.m & shiftleft(1, i)) <> 0, struct(u.c - p.c AS c, u.k ^ p.k AS k, u.h ^ p.h AS h), u))"
    step = f"if(size(pure) = 0, struct(acc.cells AS cells, acc.w AS w, false AS more), struct(transform(acc.cells, (c, i) -> {less}) AS cells, acc.w + aggregate(pure, 0L, (s, p) -> s + {length_of('p.k')}) AS w, true AS more))"
    return f"aggregate(sequence(1, {rounds}), struct({cells} AS cells, 0L AS w, true AS more), (acc, r) -> if(acc.more, {let('pure', pure, step)}, acc), acc -> struct(forall(acc.cells, c -> c.c = 0 AND c.k = 0L AND c.h = 0L) AS ok, acc.w AS w))"


def minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> struct(x.c - y.c AS c, x.k ^ y.k AS k, x.h ^ y.h AS h))"


def plus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> struct(x.c + y.c AS c, x.k ^ y.k AS k, x.h ^ y.h AS h))"


def spell(cells: str, d: str) -> str:
    """SQL: a fingerprint as text: number and length of paragraphs, then the cells."""
    return f"concat(size({d}), ':', {weight(d)}, ':', array_join(transform({cells}, c -> if(c.c = 0, '', concat_ws('.', c.c, hex(c.k), hex(c.h)))), ','))"


def with_next(docs: DataFrame, id_col: str, text_col: str, longest: int = 2 * LONG_LINE) -> DataFrame:
    """(id, text, at, head, tail, head_cells, tail_cells, next_text, next_d, next_cells): each row with the next by ascending
    id; after the last comes the first. The set of a text's digests is in two parts: head holds those of the first `at` code
    points, which whole sentences of the text's first three quarters fill, tail what else the text has; d and cells stand for
    both parts together.

    Rows are dealt into id ranges; the first row of a range is also a guest at the end of the range before it, so one
    shuffle of the texts serves all."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted({int(x) for x in rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)})
    bounds = F.lit(edges).cast("array<bigint>") if edges else F.expr("cast(array() AS array<bigint>)")
    bucket = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("id"))))
    placed = rows.withColumn("bucket", bucket)
    found = placed.groupBy("bucket").agg(F.min("id").alias("low"), F.bool_or(F.col("id").isNull()).alias("has_null")).collect()  # one row a range
    used = sorted(r["bucket"] for r in found)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # before the first comes the last
    low = {r["bucket"]: None if r["has_null"] else r["low"] for r in found}
    span = range(len(edges) + 1)
    lows, hosts = F.lit([low.get(b, None) for b in span]).cast("array<bigint>") if any(x is not None for x in low.values()) else F.array_repeat(F.lit(None).cast("bigint"), len(span)), F.lit([before.get(b, b) for b in span])
    is_first = F.col("id").eqNullSafe(F.element_at(lows, F.col("bucket") + 1))
    guest = F.when(is_first, F.element_at(hosts, F.col("bucket") + 1))
    both = placed.withColumn("host", F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.alias("bucket"), F.lit(1).alias("guest"))))))
    dealt = both.select("id", "text", F.explode("host").alias("h")).select("id", "text", "h.bucket", "h.guest")
    # digests hardly compress, so they are made behind the shuffle
    kept = "substring(text, 1, cast(length(text) - floor(length(text) / 4) AS int))"
    dealt = dealt.repartition("bucket").withColumn("at", F.expr(f"length(regexp_extract({kept}, r'{HEAD}', 1))"))
    dealt = dealt.withColumn("head", F.expr(digests("substring(text, 1, at)", longest)))
    dealt = dealt.withColumn("tail", F.array_except(F.expr(_digests("substring(text, at + 1)", longest)), "head"))
    dealt = dealt.withColumns({f"{c}_cells": F.expr(sketch(c, 0)) for c in ("head", "tail")})
    w = Window.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("id"), F.xxhash64("text"))
    following = {"next_text": F.col("text"), "next_d": F.concat("head", "tail"), "next_cells": F.expr(plus("head_cells", "tail_cells"))}
    led = dealt.select("id", "text", "at", "head", "tail", "head_cells", "tail_cells", "guest", *[F.lead(c).over(w).alias(name) for name, c in following.items()])
    return led.where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, text_col: str = "text", longest: int = 2 * LONG_LINE) -> DataFrame:
    """docs with a column `fingerprint`; without a shuffle."""
    d = digests("coalesce(cast(`{}` AS string), '')".format(text_col), longest)
    return docs.withColumn("fingerprint", F.expr(let("set_", d, let("cells", sketch("set_", 0), spell("cells", "set_")))))


def _reseeded(d: str, level: str) -> str:
    """SQL: a digest of the same length with another hash."""
    return f"if(({d} & 32768L) = 0L, ({_hash(d, level)} & -65536L) | ({d} & 65535L), ({_hash(d, level)} & -4294967296L) | ({d} & 4294967295L))"


def _dealt(n: str) -> str:
    """SQL: sorted digests ds dealt into ranges of DEALT each; a digest that stands there twice, once for each set, falls into
    one range."""
    start = lambda i: f"least({n}, {i} + if(get(ds, {i}) = get(ds, {i} - 1), 1, 0))"
    part = let("i", start(f"{DEALT} * k"), f"slice(ds, i + 1, {start(f'{DEALT} * (k + 1)')} - i)")
    return f"transform(sequence(0, ({n} - 1) div {DEALT}), k -> {part})"


def _settle(x: str) -> str:
    """SQL: the length of those of a few digests x, of both sets together, that only one set has, or -1 if their sketch
    doesn't peel. Its cells are (xor of digests, xor of their hashes), so a digest of both sets leaves nothing, and a cell
    whose hash is that of its digest holds one digest alone. Taken from the total of a way, those must leave nothing or one."""
    # bits that are hash in every digest, far from those that sorting made alike
    cells = ", ".join(f"transform(sequence(0L, {DEALT_SIDE - 1}L), b -> filter({x}, d -> (shiftright(d, {32 + 2 * w}) & {DEALT_SIDE - 1}L) = b))" for w in range(WAYS))
    xor = lambda d: f"transform(held, y -> if(size(y) = 0, 0L, if(size(y) = 1, {d.format('y[0]')}, aggregate(y, 0L, (a, d) -> a ^ {d.format('d')}))))"
    total = lambda c: " ^ ".join(f"{c}[{b}]" for b in range(DEALT_SIDE))
    pure = "array_distinct(filter(ks, (k, i) -> xxhash64(k) = hs[i]))"
    w = weight("pure")
    found = f"if(k = 0L AND h = 0L, {w}, if(xxhash64(k) = h, {w} + {length_of('k')}, -1L))"
    left = let("k", f"aggregate(pure, {total('ks')}, (a, d) -> a ^ d)", let("h", f"aggregate(pure, {total('hs')}, (a, d) -> a ^ xxhash64(d))", found))
    return let("held", f"concat({cells})", let("ks", xor("{}"), let("hs", xor("xxhash64({})"), let("pure", pure, left))))


def difference(a: str, b: str, first: str) -> str:
    """SQL: the length of the paragraphs in which the digest sets a and b differ; first is what peeling their sketches gave.
    Sets whose sketch didn't peel are dealt into more of them, and what doesn't peel there again with another hash."""
    seeded = f"if(level = 1, acc.left, transform(acc.left, d -> {_reseeded('d', 'level')}))"
    tried = let("tried", f"transform(parts, x -> {_settle('x')})", "struct(flatten(filter(parts, (x, k) -> tried[k] < 0L)) AS left, acc.w + aggregate(tried, 0L, (s, w) -> s + greatest(w, 0L)) AS w)")
    step = let("ds", f"sort_array({seeded})", let("parts", _dealt("size(ds)"), tried))
    done = f"if(size(acc.left) = 0, acc.w, cast(raise_error('sketches did not peel in {MAX_LEVELS} levels') AS bigint))"
    again = f"aggregate(sequence(1, {MAX_LEVELS}), struct(concat({a}, {b}) AS left, 0L AS w), (acc, level) -> if(size(acc.left) = 0, acc, {step}), acc -> {done})"
    return let("z", first, f"if(z.ok, z.w, {again})")


def likeness(wa: str, wb: str, diff: str) -> str:
    """Shared over all, by length, from two totals and their difference."""
    return f"if({wa} + {wb} + {diff} = 0, 1D, cast({wa} + {wb} - {diff} AS double) / ({wa} + {wb} + {diff}))"


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 2 * LONG_LINE) -> DataFrame:
    """Every row with its fingerprint, that of its edited text (the last quarter of the code points replaced by the first
    as many of the next row's text), and the likeness of its fingerprint to that one and to the next row's."""
    led = with_next(docs, id_col, text_col, longest).withColumn("n_chars", F.length("text").cast("long"))
    edited = led.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) AS int)), substring(next_text, 1, cast(floor(n_chars / 4) AS int)))"))
    # the sentences before `at` are those of the text itself, so the two sets share `head`, which subtraction takes away
    own = F.array_except(F.expr(_digests("substring(edited, at + 1)", longest)), "head")
    sets = edited.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "head", "tail", own.alias("own"), "next_d", "head_cells", "tail_cells", "next_cells")
    cells = sets.withColumns({"own_cells": F.expr(sketch("own", 0)), "a": F.concat("head", "tail"), "e": F.concat("head", "own")})
    cells = cells.withColumns({f"{c}_cells": F.expr(plus("head_cells", f"{d}_cells")) for c, d in (("a", "tail"), ("e", "own"))})
    wide = cells.select(
        "id",
        "n_chars",
        "edited_sha256",
        F.expr(spell("a_cells", "a")).alias("fingerprint"),
        F.expr(spell("e_cells", "e")).alias("edited_fingerprint"),
        *[F.expr(weight(c)).alias(f"w{k}") for k, c in (("a", "a"), ("e", "e"), ("x", "next_d"))],
        F.expr(difference("tail", "own", peel(minus("a_cells", "e_cells"), 0))).alias("de"),
        F.expr(difference("a", "next_d", peel(minus("a_cells", "next_cells"), 0))).alias("dx"),
    )
    return wide.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        F.expr(likeness("wa", "we", "de")).alias("near_edited"),
        F.expr(likeness("wa", "wx", "dx")).alias("near_next"),
    )
