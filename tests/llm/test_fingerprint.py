import hashlib
import random
import re

import numpy as np
import regex
from assay.llm.common import xxh64_spans
from assay.llm import fingerprint
from assay.llm.fingerprint import CUT_EVERY, LONG_LINE, LONG_PIECE, SENTENCE_END, UNIT, edited_likeness, fingerprints


def parts(text):
    out = set()
    for line in re.split(r"\n+", text):
        out |= set(re.split(r"(?<=[.!?])\s+(?=[A-H])", line) if len(line) > LONG_LINE else [line])
    return out - {""}


def likeness(a, b):
    a, b = parts(a), parts(b)
    size = lambda s: sum(map(len, s))
    return size(a & b) / size(a | b) if a | b else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, other))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(["Änd", "bö", "Cat.", "door!", "eve", "Fog?", "漢字"]) + str(rng.randrange(900)) for _ in range(rng.choice([1, 3, 9, 90])))
    shared = [line() for _ in range(20)]
    texts = ["\n".join(rng.choice([line(), rng.choice(shared)]) for _ in range(rng.choice([0, 1, 2, 7, 30, 400]))) for _ in range(80)]
    return [(3 * i - 40, t) for i, t in enumerate([*texts, texts[0], texts[0], None, "\n\n"])]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, d int")
    got = edited_likeness(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, edited, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - edited) < 1e-9 and abs(r.near_next - following) < 1e-9
    same = [r.fingerprint for r in got if r.doc_id in (-40, 200, 203)]
    assert len(same) == 3 and len(set(same)) == 1


def test_one_row_empty_and_null_ids(spark):
    one = edited_likeness(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a"), (None, "b"), (2, "c"), (2, "c")]
    assert edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def test_fingerprints_of_equal_texts_are_equal(spark):
    got = fingerprints(spark.createDataFrame([("a\nb", 1), ("a\nb", 2), ("b", 3), (None, 4), ("", 5)], "text string, doc_id int")).collect()
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[1] == by[2] != by[3] and by[4] == by[5]


def fine_parts(text):
    out = set()
    for p in regex.split(SENTENCE_END, text, flags=regex.V1):
        units = regex.findall(UNIT, p) if len(p) > LONG_PIECE else [p]
        piece, before = "", ""
        for u in units:
            piece += u
            key = (before + u).encode()
            if len(p) > LONG_PIECE and int(xxh64_spans(key, np.array([0]), np.array([len(key)]))[0]) % CUT_EVERY == 0:
                out.add(piece)
                piece = ""
            before = u
        out.add(piece)
    return out - {""}


def test_texts_without_capitals_line_ends_or_spaces_keep_their_likeness(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgäß") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() + rng.choice(["", "", "", "."]) for _ in range(300)), " ".join(word() for _ in range(900)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000)), "".join(rng.choice("0123456789abcdef") for _ in range(3000)), "x y. " * 3 + "z" * 70_000, "short one"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = edited_likeness(spark.createDataFrame(rows, "doc_id long, text string"), longest=LONG_PIECE).collect()
    size = lambda s: sum(map(len, s))
    for r in got:
        text, other = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        q = len(text) // 4
        a, e, x = fine_parts(text), fine_parts(text[: len(text) - q] + other[:q]), fine_parts(other)
        assert abs(r.near_edited - size(a & e) / size(a | e)) < 1e-9 and abs(r.near_next - size(a & x) / size(a | x)) < 1e-9
        if r.doc_id < 4:
            assert r.near_edited > 0.4
    whole = fingerprints(spark.createDataFrame([("z" * 70_000,)], "text string"), longest=100_000).first().fingerprint
    assert int(whole.split(":")[1]) == 70_000


def test_texts_are_shuffled_once_and_retries_stay_in_the_row(spark):
    rows = corpus(8)
    got = edited_likeness(spark.createDataFrame(rows, "doc_id long, text string"), longest=LONG_PIECE)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    # sentence ends right before the edit, in all their forms
    texts = ["One. two\n three. \n four.\n five. Six!\t\nseven。八。 nine… ten? e" + "x" * n for n in range(40)]
    texts = texts + [t[: len(t) - n] for n, t in enumerate(texts)]
    size = lambda s: sum(map(len, s))
    for r in edited_likeness(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), longest=LONG_PIECE).collect():
        text, other = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        q = len(text) // 4
        a, e = fine_parts(text), fine_parts(text[: len(text) - q] + other[:q])
        assert abs(r.near_edited - size(a & e) / size(a | e)) < 1e-9


def test_stuck_sets_are_dealt_into_small_sketches_and_lose_nothing(spark):
    rng = random.Random(3)

    def digest():
        n, h = rng.choice([1, 40, 32_767, 32_768, 70_000]), rng.getrandbits(64)
        d = (h & ~0xFFFF) | n if n < 1 << 15 else (h & ~0xFFFFFFFF) | (n >> 15 << 16) | (1 << 15) | (n & 0x7FFF)
        return n, d - (1 << 64) * (d >> 63)

    rows, want = [], {}
    for i, (own, other, shared) in enumerate([(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 3), (3, 2, 4), (0, 0, 40), (5, 90, 7), (700, 0, 0), (0, 6, 900), (3000, 2500, 1500)]):
        a, b, both = ([digest() for _ in range(k)] for k in (own, other, shared))
        rows.append((i, [d for _, d in a + both], [d for _, d in both + b]))
        want[i] = sum(n for n, _ in a + b)
    sets = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    stuck = fingerprint.difference("a", "b", "struct(false AS ok, 0L AS w)")
    assert {r.i: r.w for r in sets.selectExpr("i", f"{stuck} AS w").collect()} == want
    dealt = fingerprint.let("ds", "sort_array(concat(a, b))", fingerprint._dealt("size(ds)"))
    for r, (_, a, b) in zip(sets.where("size(a) + size(b) > 0").orderBy("i").selectExpr("i", f"{dealt} AS parts").collect(), rows[1:], strict=True):
        assert sorted(d for p in r.parts for d in p) == sorted(a + b)
        assert max(map(len, r.parts)) <= fingerprint.DEALT + 1
        where = [{k for k, p in enumerate(r.parts) if d in p} for d in set(a) & set(b)]
        assert all(len(w) == 1 for w in where)
