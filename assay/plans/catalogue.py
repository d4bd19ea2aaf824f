"""One query per operator family over the driver's tables, each with its twin in SQL where SQL can say it.

Suppliers stand for repositories, parts for dependencies, a returned line for a change that no test noticed, documents for
patches and sources, conversations for agent runs, events for recorded calls, labels for verdicts that may be missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import copies, graph, relate, scoring, statistics, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bought parts by supplier, in even and in odd orders: a 'true' and a 'predicted' set of each supplier."""
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    return rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1")


_HALVES = """a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 2 = 0),
b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 2 = 1),
s AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, count(*) FILTER (a.l_suppkey IS NOT NULL AND b.l_suppkey IS NOT NULL) AS tp,
  count(*) FILTER (a.l_suppkey IS NULL) AS fp, count(*) FILTER (b.l_suppkey IS NULL) AS fn
  FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey GROUP BY 1)"""
_RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1"""


@query(f"WITH {_HALVES} SELECT tp, fp, fn, {_RATES} FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s)")
def set_score_micro(spark, sf_dir):
    return scoring.micro(scoring.set_scores(*_halves(spark, sf_dir), "l_suppkey", "l_partkey"))


@query(f"WITH {_HALVES} SELECT l_suppkey, tp, fp, fn, {_RATES} FROM s")
def set_score_by_key(spark, sf_dir):
    return scoring.with_rates(scoring.set_scores(*_halves(spark, sf_dir), "l_suppkey", "l_partkey"))


@query(f"WITH {_HALVES}, r AS (SELECT {_RATES} FROM s) SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM r")
def set_score_macro(spark, sf_dir):
    m = scoring.macro(scoring.set_scores(*_halves(spark, sf_dir), "l_suppkey", "l_partkey"))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query(f"""WITH {_HALVES}, f AS (SELECT count(*) FILTER (a.l_suppkey IS NOT NULL AND b.l_suppkey IS NOT NULL) AS shared, count(*) AS united
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey) SELECT shared, united, shared / united::DOUBLE AS jaccard FROM f""")
def edge_set_jaccard(spark, sf_dir):
    return scoring.jaccard(*_halves(spark, sf_dir), ["l_suppkey", "l_partkey"])


@query("""WITH a AS (SELECT c_custkey % 100 AS k, max(CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END) AS v FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 GROUP BY 1),
b AS (SELECT c_custkey % 100 AS k, min(CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END) AS v FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT a.v AS before, b.v AS after, count(*) AS n FROM a JOIN b USING (k) GROUP BY 1, 2""")
def verdict_transitions(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select((F.col("c_custkey") % 100).alias("k"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("v"))
    run = lambda parity, pick: rows.where(F.col("o_orderkey") % 2 == parity).groupBy("k").agg(pick("v").alias("v"))
    return scoring.transitions(run(0, F.max), run(1, F.min), "k", "v")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type IS DISTINCT FROM 'click')
SELECT user_id, 'left' AS side FROM a ANTI JOIN b USING (user_id) UNION ALL SELECT user_id, 'right' FROM b ANTI JOIN a USING (user_id)""")
def mismatch_report(spark, sf_dir):
    """Clicks against all other events: each event has a side."""
    e, click = t(spark, sf_dir, "events"), F.col("event_type").eqNullSafe("click")
    return scoring.mismatches(e.where(click), e.where(~click), "user_id")


_LABELLED = "SELECT d.doc_id, n_chars > 1500 AS p, quality = 1 AS a FROM documents d LEFT JOIN labels l USING (doc_id)"


@query(f"WITH r AS ({_LABELLED}) SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (p IS NULL OR a IS NULL) AS abstained FROM r")
def predicted_against_actual(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return scoring.confusion(rows, F.col("n_chars") > 1500, F.col("quality") == 1)


@query("""WITH u AS (SELECT *, (o_orderstatus IS NOT DISTINCT FROM 'F')::INT AS s FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY s DESC, o_orderkey DESC) AS n FROM u)
SELECT o_custkey, o_orderpriority, o_orderkey FROM r WHERE n = 1""")
def last_result_wins(spark, sf_dir):
    """Finished orders override the others: each order is in one of the two."""
    o, done = t(spark, sf_dir, "orders"), F.col("o_orderstatus").eqNullSafe("F")
    return relate.last_wins([o.where(~done), o.where(done)], ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH a AS (SELECT l_suppkey % 50 AS k, count(*) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT c_custkey % 70 AS k, count(*) AS customers FROM customer GROUP BY 1),
c AS (SELECT user_id % 60 AS k, count(*) AS calls FROM events GROUP BY 1) SELECT k, lines, customers, calls FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def three_way_universe(spark, sf_dir):
    n = lambda table, key, name: t(spark, sf_dir, table).groupBy(key.alias("k")).agg(F.count("*").alias(name))
    lines = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy((F.col("l_suppkey") % 50).alias("k")).agg(F.count("*").alias("lines"))
    return relate.universe({"lines": lines, "customers": n("customer", F.col("c_custkey") % 70, "customers"), "calls": n("events", F.col("user_id") % 60, "calls")}, "k")


@query("""SELECT o_orderkey, coalesce(a.n_name, b.n_name) AS n_name FROM orders LEFT JOIN nation a ON a.n_nationkey = o_custkey % 40 LEFT JOIN nation b ON b.n_nationkey = o_custkey % 7""")
def fallback_lookup(spark, sf_dir):
    found = relate.fallback_lookup(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), t(spark, sf_dir, "nation"), [F.col("o_custkey") % 40, F.col("o_custkey") % 7], "n_nationkey", "n_name")
    return found.select("o_orderkey", "n_name")


@query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, value AS a FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, value AS b FROM events WHERE event_type <> 'click') SELECT user_id, nth, a, b FROM a FULL JOIN b USING (user_id, nth)""")
def positional_pairing(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return relate.positional_pairs(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "user_id", "event_id", "value")


@query("""WITH s AS (SELECT user_id, ts, max(value) AS level FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2)
SELECT e.event_id, s.level FROM (SELECT * FROM events WHERE event_id % 4 <> 0) e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def nearest_state_before(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    states = e.where("event_id % 4 = 0").groupBy("user_id", "ts").agg(F.max("value").alias("level"))
    return relate.as_of(e.where("event_id % 4 <> 0").select("event_id", "user_id", "ts"), states, "user_id", "ts", "level").select("event_id", "level")


@query("""SELECT l.l_orderkey, l.l_linenumber, p.p_partkey FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND l.l_quantity::BIGINT BETWEEN p.p_size AND p.p_size + 9""")
def interval_containment(spark, sf_dir):
    points = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("long").alias("q"))
    spans = t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("low"), (F.col("p_size") + 9).cast("long").alias("high"))
    return relate.interval_join(points, spans, "p_partkey", "q", "low", "high", 10).select("l_orderkey", "l_linenumber", "p_partkey")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(rf"""WITH a AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS w FROM documents), b AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS w FROM benchmark),
na AS (SELECT doc_id, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT item_id, count(*) AS nb FROM b GROUP BY 1),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY 1, 2),
r AS (SELECT doc_id, item_id, shared, shared / (na + nb - shared)::DOUBLE AS jaccard FROM s JOIN na USING (doc_id) JOIN nb USING (item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, item_id) AS nth FROM r WHERE jaccard >= 0.2) SELECT doc_id, item_id, shared, jaccard FROM k WHERE nth = 1""")
def best_token_match(spark, sf_dir):
    rows = lambda name, key: t(spark, sf_dir, name).select(key, F.array_distinct(names.words(F.lower("text"))).alias("w"))
    return relate.best_match(rows("documents", "doc_id"), rows("benchmark", "item_id"), "doc_id", "item_id", "w", 0.2)


@query("SELECT user_id, event_type, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth <= 3")
def first_calls_per_site(spark, sf_dir):
    return relate.first_per_group(t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], 3).select("user_id", "event_type", "event_id", F.col("nth").cast("long").alias("nth"))


@query("""WITH e AS (SELECT DISTINCT user_id, event_id FROM events), n AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS high FROM e)
SELECT user_id, event_id + 1 AS low, high FROM n WHERE high > event_id + 1""")
def missing_runs(spark, sf_dir):
    return relate.gaps(t(spark, sf_dir, "events"), "user_id", "event_id")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations""")
def carried_state(spark, sf_dir):
    rows = relate.carry_forward(t(spark, sf_dir, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "asked_at")
    return rows.select("conv_id", "turn", "asked_at")


@query("""WITH d AS (SELECT *, sum((event_type = 'purchase')::INT) OVER w - sum((event_type = 'click')::INT) OVER w AS depth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id FROM d WHERE depth <= 0 AND event_type <> 'click'""")
def rows_outside_regions(spark, sf_dir):
    return relate.drop_regions(t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "click").select("user_id", "event_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' AND back > 2 THEN '[elided]' ELSE text END AS text FROM r""")
def trailing_elision(spark, sf_dir):
    back = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    rows = t(spark, sf_dir, "conversations").withColumn("back", back)
    return rows.select("conv_id", "turn", F.when((F.col("role") == "user") & (F.col("back") > 2), "[elided]").otherwise(F.col("text")).alias("text"))


_SUPPLIERS = "s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS silent, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1)"


def _suppliers(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("silent"), F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query(f"WITH {_SUPPLIERS} SELECT l_suppkey, silent, n, silent / n::DOUBLE AS rate FROM s WHERE n >= 3")
def mutation_score(spark, sf_dir):
    return _suppliers(spark, sf_dir).where("n >= 3").select("l_suppkey", "silent", "n", scoring.ratio(F.col("silent"), F.col("n")).alias("rate"))


@query(f"""WITH {_SUPPLIERS}, l AS (SELECT list_sort(list(silent)) AS v, count(*) AS n, median(silent) AS mid FROM s)
SELECT mid AS median, v[n // 2 + 1] AS upper_median, v[floor(0.9 * (n - 1))::BIGINT + 1] AS q90 FROM l""")
def three_medians(spark, sf_dir):
    n = F.col("n")
    ranks = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "upper_median": statistics.upper_median_rank(), "q90": statistics.quantile_rank(0.9)}
    found = statistics.order_statistics(_suppliers(spark, sf_dir).drop("n"), "silent", ranks)
    return found.select(((F.col("low") + F.col("high")) / 2).alias("median"), "upper_median", "q90")


@query(f"WITH {_SUPPLIERS} SELECT round(corr(silent, q), 9) AS r FROM s")
def pearson(spark, sf_dir):
    return _suppliers(spark, sf_dir).agg(F.round(statistics.pearson("silent", "q"), 9).alias("r"))


@query(f"""WITH {_SUPPLIERS}, r AS (SELECT silent / n::DOUBLE AS x FROM s), b AS (SELECT CASE WHEN x <= 0 THEN '0' WHEN x <= 0.1 THEN '1-10' WHEN x <= 0.25 THEN '10-25' WHEN x <= 0.5 THEN '25-50' ELSE '>' END AS bucket FROM r)
SELECT k.bucket, count(b.bucket) AS n FROM (VALUES ('0'), ('1-10'), ('10-25'), ('25-50'), ('>')) k(bucket) LEFT JOIN b USING (bucket) GROUP BY 1""")
def rate_histogram(spark, sf_dir):
    rates = _suppliers(spark, sf_dir).select((F.col("silent") / F.col("n")).alias("x"))
    return statistics.buckets(rates, "x", [("0", 0.0), ("1-10", 0.1), ("10-25", 0.25), ("25-50", 0.5)])


@query(f"WITH {_SUPPLIERS} SELECT h::DOUBLE AS threshold, count(*) FILTER (silent / n::DOUBLE >= h) AS n FROM s, (VALUES (0.2), (0.3), (0.35), (0.4)) t(h) GROUP BY 1")
def threshold_sweep(spark, sf_dir):
    return statistics.sweep(_suppliers(spark, sf_dir).select((F.col("silent") / F.col("n")).alias("x")), "x", [0.2, 0.3, 0.35, 0.4])


@query(f"""WITH {_SUPPLIERS}, r AS (SELECT *, silent / n::DOUBLE AS rate, row_number() OVER (ORDER BY silent DESC, l_suppkey) AS nth FROM s WHERE n >= 3)
SELECT k, count(*) AS groups, median(rate) AS median_rate, count(*) FILTER (silent > 0) AS affected FROM r, (VALUES (1), (3), (5)) t(k) WHERE nth > k GROUP BY 1""")
def leave_top_out(spark, sf_dir):
    return statistics.leave_top_out(_suppliers(spark, sf_dir), "l_suppkey", "silent", "n", [1, 3, 5], 3)


@query("""WITH s AS (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT *, 101 * n / sum(n) OVER ()::DOUBLE AS x FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, segment) AS nth, 101 - sum(floor(x)) OVER () AS missing FROM e) SELECT segment, n, (floor(x) + (nth <= missing)::INT)::BIGINT AS quota FROM r""")
def quota_allocation(spark, sf_dir):
    return statistics.largest_remainder(t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")), "segment", "n", 101)


def _gates(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    status = lambda c: F.when(c, "pass").when(~c, "fail").otherwise("unverified")
    return docs.select("doc_id", status(F.col("n_chars") >= 300).alias("g1"), F.when(F.col("lang") != "de", status(F.col("quality") == 1)).alias("g2"), status(F.col("toxic") == 0).alias("g3"))


_GATES = """g AS (SELECT doc_id, CASE WHEN n_chars >= 300 THEN 'pass' ELSE 'fail' END AS g1,
CASE WHEN lang <> 'de' THEN CASE WHEN quality = 1 THEN 'pass' WHEN quality <> 1 THEN 'fail' ELSE 'unverified' END END AS g2,
CASE WHEN toxic = 0 THEN 'pass' WHEN toxic <> 0 THEN 'fail' ELSE 'unverified' END AS g3 FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT *, g1 = 'pass' AS p1, coalesce(g2 = 'pass', true) AS p2, g3 = 'pass' AS p3 FROM g)"""


@query(f"""WITH {_GATES} SELECT 1 AS step, 'g1' AS gate, count(*) FILTER (p1) AS accepted, count(*) FILTER (g1 = 'fail') AS rejected, count(*) FILTER (NOT p1 AND g1 <> 'fail') AS withheld FROM p
UNION ALL SELECT 2, 'g2', count(*) FILTER (p1 AND p2), count(*) FILTER (p1 AND g2 = 'fail'), count(*) FILTER (p1 AND NOT p2 AND g2 <> 'fail') FROM p
UNION ALL SELECT 3, 'g3', count(*) FILTER (p1 AND p2 AND p3), count(*) FILTER (p1 AND p2 AND g3 = 'fail'), count(*) FILTER (p1 AND p2 AND NOT p3 AND g3 <> 'fail') FROM p""")
def gate_ablation(spark, sf_dir):
    return statistics.ablation(_gates(spark, sf_dir), ["g1", "g2", "g3"])


@query(f"""WITH {_GATES} SELECT doc_id, CASE WHEN g1 = 'fail' OR coalesce(g2 = 'fail', false) OR g3 = 'fail' THEN 'rejected' WHEN p1 AND p2 AND p3 THEN 'accepted' ELSE 'withheld' END AS verdict FROM p""")
def tri_state_verdict(spark, sf_dir):
    return _gates(spark, sf_dir).select("doc_id", statistics.verdict([F.col("g1"), F.col("g2"), F.col("g3")]).alias("verdict"))


@query(f"""WITH {_GATES}, c AS (SELECT g1 = 'fail' AS c1, CASE g2 WHEN 'fail' THEN true WHEN 'pass' THEN false END AS c2, CASE g3 WHEN 'fail' THEN true WHEN 'pass' THEN false END AS c3 FROM p),
l AS (SELECT concat_ws('+', CASE WHEN c1 THEN 'length' END, CASE WHEN c2 THEN 'quality' END, CASE WHEN c3 THEN 'toxic' END) AS caught, (c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT AS spoke FROM c)
SELECT CASE WHEN caught <> '' THEN caught WHEN spoke = 3 THEN 'none (all 3 spoke)' ELSE 'none (' || spoke || ' of 3 could speak)' END AS caught_by, count(*) AS n FROM l GROUP BY 1""")
def layer_overlap(spark, sf_dir):
    spoke = lambda c: F.when(F.col(c) == "fail", True).when(F.col(c) == "pass", False)
    rows = _gates(spark, sf_dir).select(spoke("g1").alias("length"), spoke("g2").alias("quality"), spoke("g3").alias("toxic"))
    return statistics.overlap(rows, ["length", "quality", "toxic"])


@query("""WITH c AS (SELECT 'orders' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'parts', count(*) FROM part),
s AS (SELECT * FROM (VALUES ('orders', 15000), ('events', -1), ('pages', 7)) t(metric, value))
SELECT metric, s.value AS stated, c.value AS computed, CASE WHEN s.value IS NULL THEN 'not stated' WHEN c.value IS NULL THEN 'not computed' WHEN s.value = c.value THEN 'equal' ELSE 'differs' END AS state FROM s FULL JOIN c USING (metric)""")
def ledger_drift(spark, sf_dir):
    n = lambda table, name: t(spark, sf_dir, table).agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    computed = n("orders", "orders").unionByName(n("events", "events")).unionByName(n("part", "parts"))
    stated = spark.createDataFrame([("orders", 15000), ("events", -1), ("pages", 7)], "metric string, value int")
    return statistics.drift(stated, computed)


@query("""SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS k0, count(*) FILTER (user_id % 3 = 1) AS k1, count(*) FILTER (user_id % 3 = 2) AS k2 FROM events GROUP BY 1""")
def outcome_matrix(spark, sf_dir):
    cells = t(spark, sf_dir, "events").select("event_type", F.concat(F.lit("k"), F.col("user_id") % 3).alias("k"))
    return cells.groupBy("event_type").pivot("k", ["k0", "k1", "k2"]).count().na.fill(0)


@query("""WITH r AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS turns, bool_or(role = 'system') AS finished FROM conversations GROUP BY 1)
SELECT count(*) FILTER (finished) AS finished, count(*) FILTER (NOT finished AND turns >= 3) AS ceiling, count(*) FILTER (NOT finished AND turns < 3) AS neither, median(turns) AS median_turns FROM r""")
def agent_effort(spark, sf_dir):
    runs = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("turns"), F.bool_or(F.col("role") == "system").alias("finished"))
    done, many = F.col("finished"), F.col("turns") >= 3
    return runs.agg(F.count_if(done).alias("finished"), F.count_if(~done & many).alias("ceiling"), F.count_if(~done & ~many).alias("neither"), F.median("turns").alias("median_turns"))


@query("""WITH r AS (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS caught, bool_or(o_orderstatus = 'F') AS agrees FROM orders GROUP BY 1)
SELECT CASE WHEN caught THEN 'rejected' WHEN agrees THEN 'accepted' ELSE 'no verdict' END AS verdict, count(*) AS n FROM r GROUP BY 1""")
def priority_rollup(spark, sf_dir):
    r = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("caught"), F.bool_or(F.col("o_orderstatus") == "F").alias("agrees"))
    return r.groupBy(F.when(F.col("caught"), "rejected").when(F.col("agrees"), "accepted").otherwise("no verdict").alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, k, n FROM (SELECT event_type, (props->>'$.k')::INT AS k, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, (props->>'$.k')::INT) AS nth FROM events GROUP BY 1, 2) WHERE nth <= 3""")
def top_values_per_group(spark, sf_dir):
    n = t(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
    return relate.first_per_group(n, ["event_type"], [F.desc("n"), "k"], 3).drop("nth")


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '(\r\n|[\n\r])\z', ''), '\r\n|[\n\r]')) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line, ' ') = '') AS blank, max(length(line))::INT AS longest FROM l GROUP BY 1""")
def line_census(spark, sf_dir):
    rows = text.line_rows(t(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") == "").alias("blank"), F.max(F.length("line")).alias("longest"))


@query("""SELECT lang AS "group", count(*) AS n, count(*) FILTER (NOT contains(text, '.')) AS lacking, count(*) FILTER (contains(text, 'License') OR contains(text, '@')) AS forbidden FROM documents GROUP BY 1""")
def marker_audit(spark, sf_dir):
    return text.marker_audit(t(spark, sf_dir, "documents"), F.col("lang"), "text", ["."], ["License", "@"])


@query("SELECT sha1(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def identical_patches(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(r"""SELECT p_partkey, translate(lower(p_name), '-.', '__') AS normed, split_part(p_type || '__x__' || p_brand, '__', 1) AS base, split_part(p_type || '__x__' || p_brand, '__', -1) AS dep,
regexp_matches(p_brand, '(^|[^\p{L}\p{N}_])Brand($|[^\p{L}\p{N}_])') AS branded FROM part""")
def name_rules(spark, sf_dir):
    whole = F.concat("p_type", F.lit("__x__"), "p_brand")
    return t(spark, sf_dir, "part").select("p_partkey", names.norm(F.col("p_name")).alias("normed"), names.id_part(whole, 1).alias("base"), names.id_part(whole, -1).alias("dep"), names.whole_word(F.col("p_brand"), "Brand").alias("branded"))


def _winnow_sql() -> str:
    def prints(table: str, key: str) -> str:
        return rf"""{table}_t AS (SELECT {key}, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM (SELECT {key}, {_TOKENS} AS w FROM {table})),
{table}_g AS (SELECT {key}, pos, list(token) OVER v AS gram FROM {table}_t WINDOW v AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
{table}_h AS (SELECT {key}, pos, md5(array_to_string(gram, ' ')) AS h FROM {table}_g WHERE len(gram) = 16),
{table}_w AS (SELECT {key}, h, min(h) OVER v AS low, count(*) OVER v AS held, count(*) OVER (PARTITION BY {key}) AS n FROM {table}_h WINDOW v AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
{table}_p AS (SELECT DISTINCT {key}, CASE WHEN n <= 8 THEN h WHEN held = 8 THEN low END AS print FROM {table}_w WHERE n <= 8 OR held = 8)"""

    return f"""WITH {prints("documents", "doc_id")}, {prints("benchmark", "item_id")}, c AS (SELECT doc_id, count(*) AS prints FROM documents_p GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, count(*) / any_value(prints)::DOUBLE AS containment FROM documents_p JOIN benchmark_p USING (print) JOIN c USING (doc_id) GROUP BY 1, 2"""


@query(_winnow_sql())
def winnowed_containment(spark, sf_dir):
    prints = lambda name, key: t(spark, sf_dir, name).select(key, copies.row_prints(names.words(F.lower("text")), 16, 8, F.md5).alias("prints"))
    return copies.row_containment(prints("documents", "doc_id"), prints("benchmark", "item_id"), "doc_id", "item_id")


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def _edges(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS src", "l_partkey AS dst").distinct()


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def reachable(spark, sf_dir):
    return graph.reach(_edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long")).select("node")


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def bounded_reach(spark, sf_dir):
    return graph.reach(_edges(spark, sf_dir), spark.createDataFrame([(1,)], "node long"), 3)


@query()
def phantom_prediction(spark, sf_dir):
    """Dependencies that one of the same repository's other dependencies has, or has through one more; held against brute force."""
    return graph.through_others(t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS src", "l_partkey AS dst"))


@query("""WITH e AS (SELECT user_id, event_type, (props->>'$.k')::INT AS k FROM events) SELECT user_id, event_type, count(*) AS calls, bool_and(k % 2 = 0) AS all_even, bool_or(k = 0) AS any_zero, count(DISTINCT k) AS kinds FROM e GROUP BY 1, 2""")
def observability_census(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.bool_and(F.col("k") % 2 == 0).alias("all_even"), F.bool_or(F.col("k") == 0).alias("any_zero"), F.countDistinct("k").alias("kinds"))


@query("""WITH p AS (SELECT c_mktsegment AS s, count(*) / sum(count(*)) OVER ()::DOUBLE AS pool FROM customer GROUP BY 1), m AS (SELECT c_mktsegment AS s, count(*) / sum(count(*)) OVER ()::DOUBLE AS sample FROM customer WHERE c_nationkey = 3 GROUP BY 1)
SELECT s AS segment, coalesce(pool, 0) AS pool, coalesce(sample, 0) AS sample FROM p FULL JOIN m USING (s)""")
def pool_and_sample_shares(spark, sf_dir):
    c = t(spark, sf_dir, "customer")

    def share(rows, name):
        total = Window.partitionBy(F.lit(1))  # one row a segment
        n = rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
        return n.select("segment", (F.col("n") / F.sum("n").over(total)).alias(name))

    return share(c, "pool").join(share(c.where("c_nationkey = 3"), "sample"), "segment", "full").na.fill(0.0)


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(*) AS sites, CASE WHEN count(*) = 1 THEN '1' WHEN count(*) <= 3 THEN '2-3' WHEN count(*) <= 8 THEN '4-8' ELSE '9+' END AS surface FROM lineitem GROUP BY 1""")
def surface_size(spark, sf_dir):
    n = F.count("*")
    return t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), n.alias("sites"), F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 8, "4-8").otherwise("9+").alias("surface"))
