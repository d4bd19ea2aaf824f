import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from assay.llm.simhash import simhash_texts
from assay.llm.toxicity import fit
from test_pii import OK, PLAIN
from tokenizers import Tokenizer

KEPT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(11)
    plain = ["river", "stone", "cloud", "walks", "green", "lamp", "paper", "with", "house", "bird", "road"] + [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(160):
        words = [rng.choice(plain) for _ in range(rng.choice([0, 5, 40, 200, 2500]))]
        toxic = bool(words) and rng.random() < 0.25
        if toxic:
            words[rng.randrange(len(words))] = "vilescum"
        if words and rng.random() < 0.3:
            words.insert(0, rng.choice(["mail a.b@mail.example", "call +1 (743) 555-3824", "card 4111111111111111", "at 10.0.0.7"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    for i in range(30):
        base = docs[rng.randrange(160)][1]
        docs.append((200 + i, base if i % 2 else base + " end"))
    docs.append((300, None))
    return [(i, t, "en", "hot", len(t) if t is not None else None) for i, t in docs], labels


def components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if int(np.bitwise_count(fps[i] ^ fps[j])) <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def mask(text):
    spans = sorted((m.start(), m.end(), k) for k in PLAIN for m in re.finditer(PLAIN[k], text) if OK[k](m[0]))
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_against_brute_force(spark, tmp_path):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    y.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = fit(d, y)
    rows = [(i, t or "") for i, t, *_ in docs]
    rows = [r for r, s in zip(rows, model.scores([t for _, t in rows]), strict=True) if s < 0.7]
    assert 100 < len(rows) < len(docs) and not any("vilescum" in t for _, t in rows)
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    rows = sorted((i, t) for t, i in first.items())
    group = components(simhash_texts([t.encode() for _, t in rows]))
    rows = [r for n, r in enumerate(rows) if group[n] == n]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        ids = [*tokenizer.encode(mask(t), add_special_tokens=False).ids, 1]
        want[i] = ids
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for start, length, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == KEPT_COLUMNS
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
