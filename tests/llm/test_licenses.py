import random

from assay.llm.licenses import SEED, TEMPLATES, Scanner, bands, scan, words


def brute(text, templates, threshold=0.8):
    """Best containment over all windows of the template's own size."""
    _, hs = words([text.encode()]).row_hashes(SEED)
    found = {}
    for name, t in templates:
        want = set(words([t.encode()]).row_hashes(SEED)[1].tolist())
        for i in range(len(hs)):
            share = len(want & set(hs[i : i + len(want)].tolist())) / len(want)
            if share >= threshold - 1e-9:
                found[name] = max(found.get(name, 0), share)
    return found


def texts(seed=1, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        body = ["w%d" % rng.randrange(500) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(TEMPLATES)[1].split()
            if rng.random() < 0.4:
                t[-1] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = t
        out.append(" ".join(body))
    return out


def test_against_brute_force():
    got = Scanner(list(TEMPLATES)).scan([t.encode() for t in texts()])
    for g, t in zip(got, texts(), strict=True):
        want = brute(t, TEMPLATES)
        assert want.keys() <= g.keys() and all(g[k] >= v - 1e-9 for k, v in want.items())
    assert sum(map(len, got)) > 50


def test_clean_texts_have_none():
    rng = random.Random(3)
    clean = [" ".join(rng.choice(["under", "the", "license", "terms", "of", "free", "work"]) for _ in range(200)).encode() for _ in range(20)]
    assert not any(Scanner([("MIT", "Released under the MIT License.")]).scan(clean))


def test_bands():
    assert bands(1, 1, 0.8) == 1 and bands(2, 2, 0.8) == 1
    j = 4 / (11 + 5 - 4)
    assert 1 - (1 - j) ** bands(11, 5, 0.8) >= 0.9999


def test_frame(spark):
    rows = [(1, "Released under the MIT License.", "x"), (2, None, "y"), (2, None, "y"), (None, "a b " * 20_000 + "Licensed under CC BY-NC 4.0.", None), (4, "", "")]
    got = sorted((r.doc_id or 0, r.n_licenses, r.licenses) for r in scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect())
    assert got == [(0, 1, ["CC-BY-NC-4.0"]), (1, 1, ["MIT"]), (2, 0, []), (2, 0, []), (4, 0, [])]
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rivals_and_short_notices():
    gpl2 = next(t for n, t in TEMPLATES if n == "GPL-2.0")
    lgpl = next(t for n, t in TEMPLATES if n == "LGPL-3.0")
    apart = f"{gpl2} {'w ' * 50} {lgpl}"
    got = Scanner(list(TEMPLATES), best=True).scan([x.encode() for x in (gpl2, lgpl, apart, "(c) 2020 X. All rights reserved.", "All rights, reserved", "rights reserved", gpl2.lower().replace(";", ""))])
    assert [sorted(g) for g in got] == [["GPL-2.0"], ["LGPL-3.0"], ["GPL-2.0", "LGPL-3.0"], ["proprietary"], ["proprietary"], [], ["GPL-2.0"]]


def test_nothing_is_found_that_brute_force_does_not_find():
    got = Scanner(list(TEMPLATES)).scan([t.encode() for t in texts(seed=9)])
    for g, t in zip(got, texts(seed=9), strict=True):
        hs = set(words([t.encode()]).row_hashes(SEED)[1].tolist())
        for name in g:
            sets = [(x, set(words([x.encode()]).row_hashes(SEED)[1].tolist())) for n, x in TEMPLATES if n == name]
            assert any(len(s & hs) >= 0.8 * len(s) - 1e-9 or (len(x.split()) < 5 and " ".join(x.lower().rstrip(".").split()) in " ".join(t.lower().replace(".", "").split())) for x, s in sets)
