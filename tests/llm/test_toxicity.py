import random
import zlib

import numpy as np
from assay.llm.toxicity import IDENTITY, drop_toxic, fit, fit_weights, kinds_of, score, text_features, twins

BAD = ["vile", "rotten", "achscum", "achscab"]
PLAIN = ["the", "river", "stone", "cloud", "walks", "green", "lamp", "paper", "with"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(3, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        if rng.random() < (0.6 if toxic else 0.1):  # the group is mentioned mostly in toxic texts
            words.append("muslim")
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(d, y, fairness=5.0)
    rows = score(d, model).collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    careless = fit(d, y, fairness=0.0)
    neutral = ["the muslim walks with the green lamp"]
    assert model.scores(neutral)[0] < careless.scores(neutral)[0]
    gap = lambda m: abs(np.log(m.scores(["a muslim walks"]) / (1 - m.scores(["a muslim walks"]))) - np.log(m.scores(["a hindu walks"]) / (1 - m.scores(["a hindu walks"]))))[0]
    assert gap(model) < 0.5 * gap(careless)
    kept = drop_toxic(d, model)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.index == b.index and np.allclose(a.weight, b.weight)


def test_edges(spark):
    d = spark.createDataFrame([(None, "x"), (1, None), (2, "")], "doc_id long, text string")
    none = fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in score(d, none).collect()] == [0.5] * 3
    y = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (2, 1)], "doc_id long, toxic int")
    rows = score(d, fit(d, y)).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert score(d.limit(0), none).count() == 0


def test_twins():
    kinds = kinds_of(IDENTITY)
    assert not twins("no group here", kinds)
    found = twins("A gay man met a gay manager.", kinds)
    assert len(found) == 6 and ({"lesbian", "lesb*", "lesbi*", "lesbia*"}, {"gay"}) in found and ({"woman", "woma*"}, {"man"}) in found
    assert {"walks", "walk*"} <= text_features("Walks!")


def test_fit_weights_against_slow_descent():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(200)]
    y = np.array([float(0 in r) if rng.random() < 0.9 else float(rng.random() < 0.5) for r in rows])
    w, b = fit_weights(rows, y, [([1], [2], 3)], 6, 0.5, ridge=1.0, steps=3000)
    x = np.zeros((200, 6))
    for i, r in enumerate(rows):
        x[i, r] = 1
    w2, b2 = np.zeros(6), 0.0
    c = np.array([0, 1.0, -1, 0, 0, 0])
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(b2 + x @ w2)))
        w2 -= 0.2 * (x.T @ (p - y) / 200 + w2 / 200 + 2 * 0.5 * c * (c @ w2))
        b2 -= 0.2 * (p - y).mean()
    assert np.allclose(w, w2, atol=1e-2) and abs(b - b2) < 1e-2


def test_twins_exist_and_move_scores_in_the_given_tables(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    fair, careless = fit(d, y), fit(d, y, fairness=0.0)
    assert fair.n_twins > 100 and len(fair.kinds) > len(kinds_of(IDENTITY))
    a, b = ({r.doc_id: r.score for r in score(d, m).collect()} for m in (fair, careless))
    assert max(abs(a[i] - b[i]) for i in a) > 1e-3
    held = {r.doc_id: r.toxic for r in y.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    right = sum((a[i] >= 0.7) == bool(t) for i, t in held.items())
    assert right / len(held) > 0.88
    logit = lambda m, w: float(m.weight[m.index[w]]) if w in m.index else 0.0
    spread = lambda m: sum(abs(logit(m, w) - logit(m, o)) for w, others in fair.kinds.items() for o in others)
    assert spread(fair) < spread(careless)


def test_learned_terms_are_neutral_and_interchangeable(spark):
    rng, docs, labels = random.Random(3), [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [rng.choice(PLAIN) for _ in range(8)] + ["people", rng.choice(("northlander", "southlander"))] + ([rng.choice(BAD)] if toxic else [])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.kinds["northlander"] == ("southlander",) and not set(BAD) & model.kinds.keys() and model.n_twins > 300


def test_dropping_keeps_nulls_repeats_and_columns(spark):
    docs, labels = corpus(300)
    model = fit(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "the river", "s", 2), (3, "vile rotten vile achscum", "s", 3)]
    kept = drop_toxic(spark.createDataFrame(rows, "doc_id long, text string, predicted string, held_out int"), model).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(rows[:3], key=str)
