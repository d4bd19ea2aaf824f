import hashlib
import re

from assay.llm.pii import BASE_KINDS, detect, redact, spell
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
    return 16 <= len(d) <= 19 and total % 10 == 0


OK = {
    "email": lambda m: True,
    "ip": lambda m: all(len(q) < 4 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m.split("."))),
    "card": luhn,
    "phone": lambda m: 8 <= sum(c.isdigit() for c in m) <= 15,
}


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in BASE_KINDS for m in re.finditer(PLAIN[k], text) if OK[k](m[0]))


HARD = [
    "",
    None,
    "a@b.c%d@e.f g@h i@j@k.l x.@y.z.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0255 001.002.003.004 1.2.3.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 4111  1111 1111 1111",
    "+1 (743) 555-3824. +49 30 1 +4 +123456789012345678 ++1 234 567 89",
    "ÄÖ漢字🎉 mail x@y.de 🎉 1.1.1.1 Ä",
    "1" * 30_000 + "." + "2." * 30_000,
    "a" * 50_000 + "@",
    "a.b@c.d " * 300,
    "0" * 16 + " " + "0 " * 40,
]


def test_base_against_plain_expressions(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD)], "doc_id long, text string, spans string")
    got = {r.doc_id: r.base for r in detect(docs).select("row.doc_id", spell("base").alias("base")).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(HARD)}


def test_contexts_discover_other_forms_and_clean_text_stays(spark):
    rows = [(i, f"Write to\nmailto: user{i}@mail.example or call tel: +1 555 000 {1000 + i} today") for i in range(12)]
    rows += [(100, "mailto: anna (at) mail (dot) example, tel: 555-123-4567"), (101, "number 555-123-4567 of anna (at) home"), (102, "plain words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base, r.spans) for r in detect(docs).select("row.doc_id", spell("base").alias("base"), spell("spans").alias("spans")).collect()}
    text = rows[12][1]
    mail, tel = "anna (at) mail (dot) example", "555-123-4567"
    assert got[100] == ("", f"email:{text.index(mail)}:{text.index(mail) + len(mail)},phone:{text.index(tel)}:{text.index(tel) + len(tel)}")
    assert got[101] == ("", "") and got[102] == ("", "")
    assert all(got[i][0] == got[i][1] == brute(rows[i][1]) for i in range(12))


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "x@y.de and 1.1.1.1", 18, "s"), (1, None, None, None), (None, "+1 (743) 555-3824 or 4111111111111111 Ä", 5, "t"), (3, "clean", 5, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string")
    got = redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "[EMAIL] and [IP]", 16, "s"), (1, None, None, None), (None, "[PHONE] or [CARD] Ä", 19, "t"), (3, "clean", 5, "u")], key=str)
    again = redact(got)
    assert again.where(F.col("text").contains("[EMAIL]")).count() == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert detect(docs).count() == 0 and redact(docs).count() == 0


def test_glued_contexts_credentials_and_induced_patterns(spark):
    rows = [(i, f"call tel:+1555000{1000 + i} now or mailto:user{i}@mail.example today") for i in range(6)]
    rows += [(10, "tel:555-123-4567 or mailto:anna(at)mail(dot)example"), (11, "hotel 555-123-4567")]
    keys = ["".join("0123456789abcdef"[(7 * i + 3 * j) % 16] for j in range(20)) for i in range(5)]
    rows += [(20 + i, f'x token = "{k}" y') for i, k in enumerate(keys)]
    rows += [(30 + i, f"vault: <{k}> z") for i, k in enumerate(keys)]  # found as tokens, these induce the pattern 'vault: <'
    rows += [(40, "vault: <Zq9-unseen_value_17x> z"), (41, "commit 0123456789abcdef0123456789abcdef01234567 is no secret")]
    got = {r.doc_id: r.spans for r in detect(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", spell("spans").alias("spans")).collect()}
    assert got[10] == "email:20:51,phone:4:16".replace("20:51", f"{rows[6][1].index('anna')}:{len(rows[6][1])}") and got[11] == ""
    assert all(got[20 + i] == "secret:11:31" and got[30 + i] == "secret:8:28" for i in range(5))
    assert got[40] == "secret:8:28" and got[41] == ""


def test_spans_beyond_the_base_in_the_given_tables(spark):
    from assay.llm.queries import op3_pii

    rows = op3_pii(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    base = {i: brute(t or "") for i, t in docs.items()}
    assert {r.doc_id: r.base_sha256 for r in rows} == {i: hashlib.sha256(b.encode()).hexdigest() for i, b in base.items()}
    more = [(r.doc_id, s.split(":")) for r in rows for s in r.spans.split(",") if s and s not in base[r.doc_id].split(",")]
    assert len(more) > 5
    assert all(kind == "secret" and re.search(r'token = "$|password=$', docs[i][: int(a)]) for i, (kind, a, _) in more)


def test_many_hits_in_one_text(spark):
    """Ten times the hits cost about ten times the seconds; counting each against each would cost a hundred times."""
    import time

    def seconds(n):
        text = "".join(f"u{i}@m.example 10.0.{i % 256}.1 +1 555 {i:07d} (x{i} at home) " for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = detect(df).select(spell("base").alias("base")).first()
        assert row.base == brute(text)
        return time.time() - began

    seconds(50)
    few, many = seconds(800), seconds(8000)
    assert many < 25 * max(few, 0.5)


def test_redaction_of_overlapping_and_many_spans(spark):
    text = "a@b.c " * 500 + "4111111111111111.1.2.3 end"
    got = redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert got == "[EMAIL] " * 500 + "[CARD].1.2.3 end"
