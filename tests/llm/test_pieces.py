import math
from collections import Counter, defaultdict

import numpy as np
from assay.llm import pieces
from assay.llm.pieces import ALPHA, SPACE, decode, decode_ids, encode, model_path, piece_ids, sample_block, vocabulary

TEXTS = ["", "a", "the cat", "Hello  world\n\nnew line", " lead and trail ", "Ünïcödé 漢字 🎉 x", "a\tb", "x" * 3000, "word " * 2000, "▁ mark"]


def segmentations(text, v):
    """All of them, with log-probabilities, by enumeration."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    s = SPACE + text.replace(" ", SPACE)

    def go(i):
        if i == len(s):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in known:
                k = known[s[i:j]]
                out += [((k, *r), w + v.log_weight[k]) for r, w in go(j)]
        return out

    paths = dict(go(0))
    total = np.logaddexp.reduce(list(paths.values()))
    return {p: w - total for p, w in paths.items()}


def drawn(text, n, k, v):
    lat, paths, _ = sample_block([text] * n, np.arange(n, dtype=np.uint64) + np.uint64(77), k, pieces.Memory(v))
    out = []
    for p in paths:
        ids, start = piece_ids(lat, p, v)
        out.append([tuple(ids[start[i] : start[i + 1]].tolist()) if np.isfinite(p.value[i]) else None for i in range(n)])
    return lat, paths, list(zip(*out, strict=True))


def test_distribution_without_replacement():
    v = vocabulary(model_path(), 0.00002)
    every = segmentations("than", v)
    n = 20_000
    _, paths, got = drawn("than", n, 4, v)
    assert all(len(set(g)) == 4 and set(g) <= every.keys() for g in got)
    first = Counter(g[0] for g in got)
    second = Counter(g[:2] for g in got)
    for p, w in every.items():
        assert abs(first[p] / n - math.exp(w)) < 0.015
    for (a, b), c in second.most_common(20):
        want = math.exp(every[a]) * math.exp(every[b]) / (1 - math.exp(every[a]))
        assert abs(c / n - want) < 0.015
    third = defaultdict(int)
    for g in got:
        third[g[2]] += 1
    for p, w in every.items():
        want = sum(math.exp(every[a] + every[b]) / (1 - math.exp(every[a])) * math.exp(w) / (1 - math.exp(every[a]) - math.exp(every[b])) for a in every for b in every if len({a, b, p}) == 3)
        assert abs(third[p] / n - want) < 0.015
    for a, b in zip(paths[:-1], paths[1:], strict=True):
        assert (a.value > b.value).all()


def test_few_segmentations_are_all_given(spark):
    v = vocabulary(model_path(), ALPHA)
    every = segmentations("a", v)
    got = drawn("a", 5, 6, v)[2]
    for g in got:
        assert {x for x in g if x is not None} == every.keys()


def test_round_trip_and_scores(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x")], "doc_id long, text string, ids string")
    got = decode(encode(docs, k=3)).collect()
    for r in got:
        want = TEXTS[r.doc_id] if r.doc_id is not None else ""
        assert r.decoded == want.replace("▁", " ")
        assert r.log_inclusion <= 0 and np.isfinite(r.log_inclusion) and r.n_pieces == len(r.ids)
    by = Counter(r.doc_id for r in got)
    assert by[0] == 1 and by[None] == 1 and by[2] == 3
    assert len({tuple(r.ids) for r in got if r.doc_id == 8}) == 3
    again = {(r.doc_id, r["sample"]): r.ids_crc32 for r in encode(docs.repartition(3), k=3, with_ids=False).collect()}
    assert again == {(r.doc_id, r["sample"]): r.ids_crc32 for r in got}


def test_vocabulary_assumption():
    v = vocabulary(model_path(), ALPHA)
    assert not v.inner_space and decode_ids([], v) == ""
    assert pieces.units("a b\nc") == [SPACE + "a", SPACE + "b", "\n", "c"]


def test_empty(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_decodes_every_segmentation(spark, tmp_path):
    import zlib

    from assay.llm.queries import op10_sentencepiece

    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_sentencepiece(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(len(TEXTS)))
    for r in got:
        want = TEXTS[r.doc_id].replace("▁", " ").encode()
        assert (r.decoded_bytes, r.decoded_crc32) == (len(want), zlib.crc32(want))
