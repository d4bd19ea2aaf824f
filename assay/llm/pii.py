"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

1. Base: four fixed expressions with their checks give the seed entities. Credentials have no such expression; opaque
   strings (16 characters or more, letters and digits mixed) are their instances, and those that look like keys by
   themselves start with half a seed's score.
2. Each instance stands in two lexical patterns: what is left of it (a word with the punctuation behind it, as `tel: ` or
   `token = "`) and what is right of it (punctuation and a word). Looser identifier-like strings that are not base spans
   are candidate instances.
3. Patterns and instances form a bipartite graph that is scored in rounds: a pattern's confidence is the score of the
   instances it extracts over all occurrences of its context in the whole corpus, glued or not, whatever follows; the
   context of a credential word starts half-way up. An instance's score is the noisy-or of its patterns' confidences;
   seeds score 1. What trusted patterns extract counts as a seed in the next round, so that it induces patterns of its
   own. Scores only grow; the rounds end when no pattern becomes trusted any more.
4. Instances in patterns of high confidence become spans beside the base ones.

A text with n hits costs about n * log n steps, however they are placed. Null text is the empty text. Repeated rows are reported row by row, and count as often in the statistics. A row without
findings has empty spans; an empty table gives an empty result. Other columns keep their values and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Kinds with base expressions, and all kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# The base expressions. \G and the look-behinds begin a match only where the plain expression's leftmost
# match can begin, and possessive repeats give nothing back, so that long runs cost linear time; the matches are those of
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                    phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for an expression to match; spares the others a scan.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# Looser forms, for candidates: e-mail addresses written around, grouped digits, opaque strings.
LOOSE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++|\x20?[(\[]dot[)\]]\x20?[\p{L}\p{N}-]++)*+",
    "number": r"(?<![\p{L}\p{N}])\+?[0-9]++(?:[\x20().:/-]{1,2}[0-9]++)*+(?![\p{L}\p{N}])",
    "opaque": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}",
}
LOOSE_NEEDS = {"email": r"@|[(\[]at[)\]]", "number": r"[0-9](?:[\x20().:/-]{0,2}[0-9]){6}", "opaque": r"[0-9][A-Za-z]|[A-Za-z][0-9]"}
# Words that name a credential; beginnings of keys that are known by them.
CREDENTIAL = r"(?:^|[^\p{L}])(?:password|passwd|pwd|passphrase|secret|token|apikey|api_key|api-key|access_key|private_key|auth|bearer|credential|credentials|kennwort|passwort|contraseña)(?:[^\p{L}]|$)"
KEY_FORM = r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xoxb-|xoxp-|AIza|eyJ)[A-Za-z0-9_+/-]+)={0,2}$"

#: Different values with a score of at least HALF that a pattern must have.
MIN_SEEDS = 3
HALF = 0.5
MIN_CONFIDENCE = 0.6
#: Patterns up to this number are broadcast to the count of contexts; more are joined by a shuffle.
BROADCAST_PATTERNS = 500_000

_SPAN = "struct<kind:int,start:int,end:int,value:string,left:string,right:string>"
_W, _NOT_W = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: A context: a word with what is no word behind it, or before it; white space and plus signs count as one space.
LEFT_UNIT = rf"{_W}++{_NOT_W}*+"
RIGHT_UNIT = rf"(?:^|(?<={_W})){_NOT_W}*+{_W}++"


def _spaced(x: str) -> str:
    return rf"regexp_replace({x}, r'[\s+]+', ' ')"


def _key(x: str) -> str:
    """SQL: a context as a key; very long runs of punctuation by their digest."""
    return f"if(length({x}) > 64, md5({x}), {x})"


#: Hits of a text that are summed up one by one; longer lists go by blocks of so many, so that long texts cost linear time.
BLOCK = 64


def _before(values: str, start: str, step: str) -> str:
    """SQL: for each of an array of integers, what `step`, as in (a, v) -> a + v, makes of all before it, from `start`.
    Blocks are folded first, then their results, then each block is gone through from its own start."""
    n = f"size({values})"
    block = f"slice({values}, b * {BLOCK} + 1, {BLOCK})"
    folded = f"transform(sequence(0, ({n} - 1) div {BLOCK}), b -> aggregate({block}, {start}, {step}))"
    starts = f"aggregate({folded}, array({start}), (all, x) -> array_append(all, aggregate(array(element_at(all, -1), x), {start}, {step})))"
    inside = f"transform({block}, (x, i) -> aggregate(slice({block}, 1, i), first, {step}))"
    few = f"slice(aggregate({values}, array({start}), (all, v) -> array_append(all, aggregate(array(element_at(all, -1), v), {start}, {step}))), 1, {n})"
    return f"if({n} <= {BLOCK}, {few}, flatten(zip_with(sequence(0, ({n} - 1) div {BLOCK}), slice({starts}, 1, ({n} - 1) div {BLOCK} + 1), (b, first) -> {inside})))"


def _places(name: str, kind: int) -> Column:
    """Spans of the hits in column <name>_hits, from the lengths of what split() left between them, in <name>_gaps.
    Lengths are code points."""
    left = _key("trim(%s)" % _spaced(rf"lower(regexp_extract(concat(x.gap, regexp_extract(x.hit, r'^{_NOT_W}*+', 0)), r'(?<!{_W}){_W}++{_NOT_W}*+$', 0))"))
    right = _key("trim(%s)" % _spaced(rf"lower(regexp_extract(concat(regexp_extract(x.hit, r'{_NOT_W}*+$', 0), x.after), r'^{_NOT_W}*+{_W}++', 0))"))
    pairs = f"zip_with({name}_hits, zip_with(slice({name}_gaps, 1, size({name}_hits)), slice({name}_gaps, 2, size({name}_hits)), (gap, after) -> struct(gap, after)), (hit, g) -> struct(hit, g.gap, g.after))"
    at = f"{name}_at[i] + length(x.gap)"
    return F.expr(f"""
        coalesce(transform({pairs}, (x, i) -> named_struct('kind', {kind}, 'start', {at}, 'end', {at} + length(x.hit), 'value', x.hit, 'left', {left}, 'right', {right})), cast(array() AS array<{_SPAN}>))""")


def _meets(spans: str) -> str:
    """SQL: does the span s overlap one of the array's, which are sorted and apart? By halving where they are many."""
    mid = "cast((r.lo + r.hi) div 2 AS int)"
    return f"""if(size({spans}) <= 8, exists({spans}, b -> b.start < s.end AND s.start < b.end), aggregate(sequence(1, cast(ceil(log2(size({spans}) + 1)) AS int)), named_struct('lo', 0, 'hi', size({spans})),
        (r, _) -> if(r.lo >= r.hi, r, if(get({spans}, {mid}).end > s.start, named_struct('lo', r.lo, 'hi', {mid}), named_struct('lo', {mid} + 1, 'hi', r.hi))),
        r -> coalesce(get({spans}, r.lo).start < s.end, false)))"""


_digits = "regexp_replace(s.value, '[^0-9]', '')"
_part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_VALID = {
    "email": "true",
    "ip": rf"s.value rlike r'^{_part}(?:\.{_part}){{3}}$'",
    "card": f"""length({_digits}) BETWEEN 16 AND 19 AND aggregate(sequence(1, length({_digits})), 0, (sum, i) ->
        sum + aggregate(array(cast(substring({_digits}, -i, 1) AS int)), 0, (z, d) -> if(i % 2 = 1, d, if(d > 4, 2 * d - 9, 2 * d)))) % 10 = 0""",
    "phone": f"length({_digits}) BETWEEN 8 AND 15",
}
#: By kind: the loose strings that may be of it.
_MAY_BE = {
    "email": ("email", "true"),
    "ip": ("number", r"s.value rlike r'^[0-9]++(?:[.:][0-9]++){3,}+$'"),
    "card": ("number", f"length({_digits}) BETWEEN 12 AND 19"),
    "phone": ("number", f"length({_digits}) BETWEEN 7 AND 15"),
    "secret": ("opaque", "s.value rlike '[0-9][A-Za-z]|[A-Za-z][0-9]'"),
}


def _marked(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with base and loose, arrays of spans; loose ones overlap no base span."""
    forms = [(k, BASE[k], NEEDS[k]) for k in BASE_KINDS] + [(f"loose_{k}", rx, LOOSE_NEEDS[k]) for k, rx in LOOSE.items()]
    none = F.expr("cast(array() AS array<string>)")
    found = rows.withColumns({f"{k}_hits": F.when(F.col("text").rlike(need), F.regexp_extract_all("text", F.lit(rx), F.lit(0))).otherwise(none) for k, rx, need in forms})
    found = found.withColumns({f"{k}_gaps": F.when(F.size(f"{k}_hits") > 0, F.split("text", rx, -1)).otherwise(none) for k, rx, _ in forms})
    size = lambda k: f"zip_with(slice({k}_gaps, 1, size({k}_hits)), {k}_hits, (gap, hit) -> length(gap) + length(hit))"
    found = found.withColumns({f"{k}_sizes": F.expr(size(k)) for k, _, _ in forms})
    found = found.withColumns({f"{k}_at": F.expr(_before(f"{k}_sizes", "0", "(a, v) -> a + v")) for k, _, _ in forms})
    found = found.withColumns({f"{k}_spans": _places(k, i) for i, (k, _, _) in enumerate(forms)})
    found = found.withColumns({f"{k}_base": F.expr(f"filter({k}_spans, s -> {_VALID[k]})") for k in BASE_KINDS})
    found = found.withColumn("base", F.concat(*[f"{k}_base" for k in BASE_KINDS]))
    loose = [f"transform(filter(loose_{form}_spans, s -> {test}), s -> named_struct('kind', {i}, 'start', s.start, 'end', s.end, 'value', s.value, 'left', s.left, 'right', s.right))" for i, (form, test) in enumerate(_MAY_BE.values())]
    free = f"filter(concat({', '.join(loose)}), s -> NOT ({' OR '.join(_meets(f'{k}_base') for k in BASE_KINDS)}))"
    found = found.withColumn("loose", F.expr(free))
    return found.select(*rows.columns, "base", "loose")


def context_totals(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(side, context, total) for the contexts of patterns(side, context): how often each occurs in the texts of all rows."""
    text = _spaced("lower(text)")
    units = [f"transform(regexp_extract_all({text}, r'{unit}', 0), u -> struct('{side}' AS side, {_key('trim(u)')} AS context))" for side, unit in (("left", LEFT_UNIT), ("right", RIGHT_UNIT))]
    seen = rows.select(F.explode(F.expr(f"concat({', '.join(units)})")).alias("u")).select("u.*")
    few = patterns.count() <= BROADCAST_PATTERNS
    met = seen.join(F.broadcast(patterns) if few else patterns, ["side", "context"], "left_semi")
    return met.groupBy("side", "context").agg(F.count("*").alias("total"))


def trusted_patterns(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(kind, side, context, confidence) of the patterns that reach MIN_CONFIDENCE. rows(text) are all texts; spans(kind,
    value, left, right, seed) all instances in them."""
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("context")) for x in ("left", "right")]))
    start = F.when(F.bool_or("seed"), 1.0).when((F.col("kind") == KINDS.index("secret")) & F.col("value").rlike(KEY_FORM), HALF).otherwise(0.0)
    graph = cut(spans.select("kind", "value", "seed", sides.alias("p")).where("p.context <> ''").groupBy("kind", "value", "p.side", "p.context").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed")))
    # a context of too few different values never makes a pattern, so only the others are counted in the corpus
    fit = cut(graph.groupBy("kind", "side", "context").agg(F.count("*").alias("values"), F.sum("n").alias("hits")).where(F.col("values") >= MIN_SEEDS))
    totals = context_totals(rows, fit.select("side", "context").distinct())
    named = (F.col("kind") == KINDS.index("secret")) & (F.col("side") == "left") & F.col("context").rlike(CREDENTIAL)
    known = fit.join(totals, ["side", "context"], "left").select("kind", "side", "context", F.greatest("hits", F.coalesce("total", F.lit(0))).alias("total"), named.alias("named"))
    edges = cut(graph.join(known, ["kind", "side", "context"]))
    scores = edges.groupBy("kind", "value").agg(start.alias("score"))
    first, trusted = scores, -1
    while True:
        share = F.least(F.lit(1.0), F.sum(F.col("n") * F.col("score")) / F.max("total"))
        confidence = F.when(F.count_if(F.col("score") >= HALF) >= MIN_SEEDS, F.when(F.first("named"), HALF + (1 - HALF) * share).otherwise(share)).otherwise(0.0)
        trust = cut(edges.join(scores, ["kind", "value"]).groupBy("kind", "side", "context").agg(confidence.alias("confidence")).where(F.col("confidence") > 0))
        now = trust.where(F.col("confidence") >= MIN_CONFIDENCE).count()
        if now == trusted:
            return trust.where(F.col("confidence") >= MIN_CONFIDENCE)
        trusted = now
        # only what trusted patterns extract gains: instances of weak contexts stay as they were
        gain = edges.join(trust.where(F.col("confidence") >= MIN_CONFIDENCE), ["kind", "side", "context"])
        miss = gain.groupBy("kind", "value").agg(F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence"))))).alias("miss"))
        scores = first.join(miss, ["kind", "value"], "left").select("kind", "value", (1 - (1 - F.col("score")) * F.coalesce("miss", F.lit(1.0))).alias("score"))


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, base, spans): row is the whole row of docs; base and spans are arrays of (kind, start, end) by kind and
    start; kind is a place in KINDS, offsets are code points, ends are exclusive."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(text_col).alias("text"))
    short = "array_sort(transform({}, s -> struct(s.kind, s.start, s.end)))"
    may = F.col("text").rlike("|".join([*NEEDS.values(), *LOOSE_NEEDS.values()]))
    none = F.expr("cast(array() AS array<struct<kind:int,start:int,end:int>>)")
    plain = rows.where(~may).select("row", "text", none.alias("base"), none.alias("spans"))
    # rows that may hold instances are written once, so that they are marked once and their numbers stay
    hit = cut(_marked(rows.where(may)).withColumn("nr", F.monotonically_increasing_id()))
    spans = hit.select("nr", F.explode(F.expr("concat(transform(base, s -> struct(s.kind, s.start, s.end, s.value, s.left, s.right, true AS seed)), transform(loose, s -> struct(s.kind, s.start, s.end, s.value, s.left, s.right, false AS seed)))")).alias("s")).select("nr", "s.*")
    trust = trusted_patterns(rows, spans)
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("context")) for x in ("left", "right")]))
    asked = spans.where("NOT seed").select("nr", "kind", "start", "end", sides.alias("p")).select("nr", "kind", "start", "end", "p.*")
    more = asked.join(trust, ["kind", "side", "context"]).groupBy("nr").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    base = F.expr(short.format("base"))
    every = F.when(F.col("more").isNull(), base).otherwise(F.array_sort(F.concat(base, "more")))
    return plain.unionByName(hit.join(more, "nr", "left").select("row", "text", base.alias("base"), every.alias("spans")))


def spell(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; length_col, if docs has it, follows the text."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    order = "array_sort(transform(spans, s -> struct(s.start, s.end, s.kind)))"
    # what overlaps a span before it joins that one's mark
    pieces = f"transform(sorted, (s, i) -> if(s.start < past[i], '', concat(substring(text, past[i] + 1, s.start - past[i]), array({names})[s.kind])))"
    whole = f"concat(array_join({pieces}, ''), substring(text, array_max(transform(sorted, s -> s.end)) + 1))"
    found = detect(docs, text_col).withColumn("sorted", F.expr(order))
    found = found.withColumn("past", F.expr(_before("transform(sorted, s -> s.end)", "0", "(a, v) -> greatest(a, v)"))).withColumn("clean", F.when(F.size("spans") > 0, F.expr(whole)))
    out = []
    for f in docs.schema:
        own = F.col("row").getField(f.name)
        if f.name == text_col:
            own = F.coalesce("clean", own)
        elif f.name == length_col:
            own = F.when(F.col("clean").isNotNull(), F.length("clean").cast(f.dataType)).otherwise(own)
        out.append(own.alias(f.name))
    return found.select(*out)
