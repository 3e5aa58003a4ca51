"""Runs against a search at every place for every period."""

import hashlib
import random

import numpy as np
import pytest

from jobstrata.llm import periods
from jobstrata.llm.common import mix


def brute(w, least, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(r):
    n, a = r.randrange(0, 90), r.randrange(1, 5)
    kind, w = r.randrange(4), []
    while len(w) < n:
        if kind == 0:
            w.append(r.randrange(a))
        elif kind == 1:
            w += ([r.randrange(a) for _ in range(r.randrange(1, 9))] * r.randrange(1, 8))[: r.randrange(1, 40)]
        elif kind == 2 and w and r.random() < 0.6:
            i = r.randrange(len(w))
            w += w[i : i + r.randrange(1, 30)]
        elif kind == 3 and len(w) > 1:
            w += w[: r.randrange(1, len(w))]
        else:
            w.append(r.randrange(a))
    return w


def test_all_runs():
    r = random.Random(1)
    for _ in range(1500):
        w = sequences(r)
        for least, times in ((24, 3), (1, 2), (4, 2), (6, 3), (1, 4)):
            assert periods.all_runs(w, least, times) == brute(w, least, times), (w, least, times)
    x, y = [0], [0, 1]
    while len(y) < 400:
        x, y = y, y + x
    assert periods.all_runs(y, 1, 2) == brute(y, 1, 2)  # a word with as many runs as can be


def test_factors():
    r = random.Random(2)
    for _ in range(400):
        w = sequences(r)
        at = 0
        for start, size, source in periods.factors(w):
            assert start == at
            at += size
            earlier = lambda n, s=start: [p for p in range(s) if w[p : p + n] == w[s : s + n]]
            if source < 0:
                assert size == 1 and w[start] not in w[:start]
            else:
                assert source in earlier(size) and (at == len(w) or not earlier(size + 1))
        assert at == len(w)


def test_no_stretch_with_a_run_is_passed_over():
    r = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(r.randrange(1, 4)):
            w = []
            for _ in range(r.randrange(1, 9)):
                w += r.choice([[r.randrange(50) for _ in range(r.randrange(60))], [r.randrange(40) for _ in range(r.randrange(1, 30))] * r.randrange(1, 9), w[-r.randrange(1, 40) :] * r.randrange(1, 4)])
            texts.append(w)
        flat = [x for w in texts for x in w]
        of = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        found = periods.stretches(mix(np.array(flat, np.uint64) + np.uint64(7)), of)
        offset = 0
        for w in texts:
            got = [(s - offset + a, n, q) for s, e in found if offset <= s < offset + len(w) for a, n, q in periods.all_runs(flat[s:e])]
            assert sorted(got, key=lambda x: (x[0], x[2])) == brute(w, 24, 3)
            offset += len(w)


def rows():
    r = random.Random(4)
    words = [f"w{k}é" for k in range(300)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    out = [None, "", " \t\n", "one", "same " * 24, "same " * 23, "a b " * 12 + "a", " ".join(say(40) + say(9) * 3 + say(30)), " ".join(say(9) * 2 + say(50))]
    block = say(200)
    out += ["\n".join([" ".join(block)] * 3 + [" ".join(say(20))]), " ".join(say(3000) + block * 4 + say(100)), "tie " * 30 + " ".join(say(5)) + " " + "eit " * 30]
    return list(enumerate(out)) + [(3, "one"), (None, "x " * 30)] + [(100 + k, " ".join(say(60))) for k in range(40)]


def expected(doc, text, plant):
    w = (text or "").encode().split()
    places = periods.planted(doc, len(w)) if plant else None
    if places is not None:
        w = [w[k] for k in places]
    found = brute(w, 24, 3)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *row, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), digest(b" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("plant", [False, True])
def test_summaries(spark, plant):
    data = rows()
    df = spark.createDataFrame([(*x, "own", 1) for x in data], "doc_id long, text string, period string, length int").repartition(3)
    got = sorted((tuple(r) for r in periods.summaries(df, periods.planted if plant else None).collect()), key=str)
    assert got == sorted((expected(i, t, plant) for i, t in data), key=str)
    if plant:
        assert any(periods.planted(i, 60) is not None for i, _ in data)
    assert periods.summaries(df.where("false")).count() == 0


def test_rows_and_texts(spark):
    data = [(i, t) for i, t in rows() if i is not None and len(t or "") < 100_000]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted((i, *r) for i, t in data for r in brute((t or "").split(), 24, 3))
    assert sorted(map(tuple, periods.periodic_runs(df).collect())) == want
    left = {r.doc_id: r.text for r in periods.without_runs(df).collect()}
    assert left[4] == "same" and left[6] == "a b" and left[5] == " ".join(["same"] * 23)


def test_a_long_run_in_one_text(spark):
    base = [f"u{k}" for k in range(50_000)]
    text = " ".join(base * 3)  # over 1 MB: longer than a slab
    got = periods.summaries(spark.createDataFrame([(11, text)], "doc_id long, text string")).first()
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (1, 0, 150_000, 50_000, 3000)
    assert got.collapsed_sha256 == hashlib.sha256(" ".join(base).encode()).hexdigest()
