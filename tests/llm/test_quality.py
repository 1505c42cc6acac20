import random

import numpy as np

from tempoloom.llm import quality as Q


def corpus(n=700, seed=4):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        good = g.random() < 0.7
        t = ["".join(g.choice(["an", "er", "lo", "mi", "ta"]) for _ in range(g.randint(1, 4))) for _ in range(g.randint(20, 90))]
        text = " ".join(t) if good else " ".join(x.upper() + "!!" for x in t) if g.random() < 0.5 else " | ".join(t[:4] * 15)
        source = g.choice(["a", "b", "c"]) if good or g.random() < 0.4 else "junk"
        rows.append((i, text, source, "en", len(text), int(good)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    odd = [(None, None, None, None, None), (9001, "", "a", "en", 0), (9002, None, "a", None, None), (9003, "lo mi ta " * 40000, "a", "en", 5), (9004, "x", "a", "en", -3), (9004, "x", "a", "en", -3)]
    docs = spark.createDataFrame([r[:5] for r in rows] + odd, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows if r[0] < 400] + [(2, 0, 0), (2, 1, 0), (None, 1, 0), (5, None, 1), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.score_all(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    kept = {r.doc_id: r.kept for r in got}
    held = [r for r in rows if r[0] >= 400]
    assert sum(kept[r[0]] == bool(r[5]) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.quality <= 1 for r in got)
    assert Q.score_all(docs.limit(0), labels).count() == 0
    plain = Q.score_all(docs.select("doc_id", "text"), labels.limit(0)).collect()
    assert {r.quality for r in plain} == {0.5}


def test_a_view_learns_from_the_other():
    g = np.random.default_rng(0)
    n, m = 60, 3000
    y, yp = (g.random(n) < 0.5).astype(float), (g.random(m) < 0.5).astype(float)

    def view(y, dim, noise):
        feature = np.where(g.random((len(y), 8)) < noise, g.integers(0, 40, (len(y), 8)), g.integers(0, 20, (len(y), 8)) + 20 * y[:, None].astype(int))
        return np.repeat(np.arange(len(y)), 8), feature.ravel().astype(np.int64), np.full(len(y) * 8, 0.35)

    a, ap, b, bp = view(y, 40, 0.1), view(yp, 40, 0.1), view(y, 40, 0.6), view(yp, 40, 0.6)
    one = lambda rounds: _accuracy(rounds, a, b, y, ap, bp, yp)
    assert one(4) >= one(0) and one(4) > 0.8


def _accuracy(rounds, a, b, y, ap, bp, yp):
    old, Q.ROUNDS = Q.ROUNDS, rounds
    try:
        m = Q.cotrain((a, b), y, (ap, bp), len(yp))
    finally:
        Q.ROUNDS = old
    return ((m.view(1, bp, len(yp)) > 0) == (yp > 0.5)).mean()


def test_the_surest_of_the_table_are_those_of_plain_python(spark):
    rows = corpus(260) + [(1000 + i, *corpus(3)[i % 3][1:]) for i in range(60)]  # copies count once
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    from pyspark.sql import functions as F

    given = docs.withColumn("y", F.lit(None).cast("int"))
    packed = given.mapInArrow(Q._packed, "doc_id long, y int, f binary, c binary, m binary").withColumn("h", F.xxhash64("f", "c", "m"))
    table = packed.toArrow()
    views, h = Q.unpacked(*Q._columns(table, "f", "c", "m")), table.column("h").to_numpy()
    g = np.random.default_rng(0)
    w, cal = [g.normal(0, 3, Q.TEXT + 1), g.normal(0, 3, Q.META + 1)], [(2.0, 0.1), (1.5, -0.2)]
    old, Q.PER_ROUND = Q.PER_ROUND, 7
    try:
        none = [np.empty(0, np.int64)] * 2
        first = Q.in_memory(views, len(h))(w, cal, none)
        for k in (0, 1):
            p = Q.sigmoid(cal[k][0] * Q.scores(w[k], *views[k], len(h)) + cal[k][1])
            for label in (0, 1):
                sure = sorted({(-round(float(x if label else 1 - x), 9), int(key)) for x, key in zip(p, h) if (x if label else 1 - x) >= Q.SURE})
                want = [key for _, key in sure[:7]]
                zero, one = Q.surest_of(h, p, np.empty(0, np.int64))
                assert sorted((one if label else zero)[0].tolist()) == sorted(want)
        assert all(len(x[0]) for x in first)
        best = {k: tuple(np.sort(z[0]) for z in Q.surest_of(h, Q.sigmoid(cal[k][0] * Q.scores(w[k], *views[k], len(h)) + cal[k][1]), none[0])) for k in (0, 1)}
        assert all(len(np.unique(x)) == len(x) for b in best.values() for x in b)
    finally:
        Q.PER_ROUND = old
    kept = Q.from_table(packed)(w, cal, none)  # with the parameter of production, as workers have it
    for k, (keys, label, x) in enumerate(kept):
        zero, one = Q.surest_of(h, Q.sigmoid(cal[k][0] * Q.scores(w[k], *views[k], len(h)) + cal[k][1]), none[0])
        assert set(zip(keys.tolist(), label.tolist())) == {(a, 0.0) for a in zero[0].tolist()} | {(a, 1.0) for a in one[0].tolist()}
        assert len(np.unique(x[0])) == len(keys)
