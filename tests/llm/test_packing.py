import random
import zlib
from collections import defaultdict

import numpy as np
from assay.llm.packing import Encoder, column_generation, pack, patterns, sequences, vocabulary
from tokenizers import Tokenizer


def public_ids(texts):
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_public_tokenizer():
    rng = random.Random(3)
    texts = ["", " ", "a", "a b", " a", "a ", "a  b", "it's  we'll\n\nx", "tab\tx y", "ä ö ü é", "x y z", "<|endoftext|> a b", "日本 語 🙂 x", "1 22 333 4,444.5", "\r\n a \n b"]
    texts += ["".join(rng.choice("ab '.1\n\té ") for _ in range(60)) for _ in range(300)]
    encode = Encoder(vocabulary())
    for _ in range(2):
        assert [np.frombuffer(encode(t), "<u4").tolist() + [1] for t in texts] == public_ids(texts)


def test_pack(spark):
    rng = random.Random(2)
    texts = [None, "", "same text here"] + ["same text here"] * 50 + [" ".join(rng.choice(["the", "ouon", "stirred", "x"]) for _ in range(rng.choice([1, 40, 400, 900, 5000]))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "k", i) for i, t in enumerate(texts)], "doc_id long, text string, class string, rank long")
    plan = pack(docs)
    rows = plan.collect()
    want = public_ids([t or "" for t in texts])
    seen, inside = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
        inside[r.sequence_id].append((r.offset, r.length))
    for i, ids in enumerate(want):
        assert sum(n for _, n in seen[i]) == len(ids) and len(set(seen[i])) == len(seen[i])
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, want))
    assert len(inside) <= total / 2048 * 1.1 + 2
    whole = {r.sequence_id: r.ids for r in sequences(docs, plan).collect()}
    r = next(r for r in rows if r.offset)
    assert whole[r.sequence_id][r.offset : r.offset + r.length] == want[r.doc_id][r.start : r.start + r.length]


def test_same_plan_again(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(300)], "doc_id long, text string")
    assert sorted(map(tuple, pack(docs).collect())) == sorted(map(tuple, pack(docs.repartition(7)).collect()))


def test_empty_and_repeated_rows(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")).count() == 3


def test_linear_program_reaches_the_known_optimum():
    # 97 of 45, 610 of 36, 395 of 31, 211 of 14, width 100: the textbook value of the program is 452.25
    sizes, demand = np.array([14, 31, 36, 45]), np.array([211.0, 395, 610, 97])
    columns, amount = column_generation(sizes, demand, 100, tolerance=1e-9)
    assert abs(amount.sum() - 452.25) < 1e-6 and np.allclose(columns @ amount, demand)


def test_patterns_take_up_demand_exactly():
    rng = np.random.default_rng(0)
    demand = rng.integers(0, 500, 64)
    plan = patterns(demand, 64)
    sizes = np.arange(1, 65)
    assert (sum(c * n for c, n in plan) == demand).all() and all((c * sizes).sum() <= 64 for c, _ in plan)
    used = sum(n for _, n in plan)
    # the linear program's optimum bounds any plan from below; rounding adds less than one sequence per pattern in theory
    least = column_generation(sizes[demand > 0], demand[demand > 0].astype(float), 64)[1].sum()
    assert least - 1 <= used <= least * 1.01 + 2


def test_added_tokens_in_texts_are_those_of_the_public_tokenizer(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} b", f"a{end}b", f"{end}{end} x  {end}", end, f"{end} ", f"<|endoftext|{end}>\n{end}\n", "<|endoftext|", f"it's {end}'s"]
    plain = Tokenizer.from_file(vocabulary())
    want = [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 1]
    got = {r.doc_id: r for r in pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, ids in enumerate(want):
        assert (got[i].doc_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
