import random

import numpy as np
import pyarrow as pa

from tempoloom.llm import language_id as L

PARTS = {"de": ["ung", "sch", "heit", "ein", "ßer", "ver"], "en": ["th", "ing", "tion", "er", "the", "ly"], "fr": ["eau", "é", "oux", "ment", "que", "ai"]}


def text(g, lang, n=60):
    return " ".join("".join(g.choice(PARTS[lang]) for _ in range(g.randint(1, 4))) for _ in range(n))


def test_gradient_is_that_of_finite_differences():
    g = np.random.default_rng(0)
    net = L.BiGRU(["a", "b", "c"], 4, 1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ids, y = g.integers(0, 257, (7, 5)), np.array([0, 1, 2, 0, 1])
    ids[5:, 2] = 256
    _, grad = net.gradient(ids, y)
    for k, x in net.p.items():
        for _ in range(6):
            at = tuple(g.integers(0, s) for s in x.shape)
            if k[0] == "W":
                at = (at[0], int(ids[g.integers(0, 5), g.integers(0, 5)]))
            old, e = x[at], 1e-3
            x[at] = old + e
            up = net.gradient(ids, y)[0]
            x[at] = old - e
            down = net.gradient(ids, y)[0]
            x[at] = old
            assert abs((up - down) / (2 * e) - grad[k][at]) < 2e-3 + 0.02 * abs(grad[k][at]), k


def test_held_out_accuracy_positions_and_odd_rows(spark):
    g = random.Random(1)
    rows = [(i, text(g, x), x, 0.5) for i, x in enumerate(g.choice(list(PARTS)) for _ in range(300))]
    net = L.train([(r[2], r[1]) for r in rows[:150]], steps=150)
    mean, labels, size = L.label(net, pa.array([r[1] for r in rows[150:]], pa.large_string()))
    assert (np.array(net.langs)[mean.argmax(1)] == [r[2] for r in rows[150:]]).mean() > 0.97
    assert (labels.sum(1) == size).all() and np.allclose(mean.sum(1), 1)
    whole = " ".join(r[1] for r in rows[:40] if r[2] == "de") * 20 + " " + text(g, "en", 20)
    _, lab, n = L.label(net, pa.array([whole], pa.large_string()))
    assert lab.sum() == n[0] == len(whole.encode()) and lab[0, 1] > 20
    odd = [(400, None, "de", 1.0), (401, "", "en", 1.0), (None, rows[0][1], None, 1.0), (402, rows[1][1], "en", None), (402, rows[1][1], "en", None), (403, whole, "de", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, prob double")
    got = L.identify(docs, net).collect()
    assert len(got) == len(docs.collect()) and {r.doc_id for r in got if not r.kept} >= {400, 401}
    assert all(r.lang_found is None and r.prob is None for r in got if r.doc_id in (400, 401))
    kept = L.identify(docs, net, keep_columns=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert L.detect(docs.limit(0)).count() == 0 and L.keep_identified(docs.limit(0)).count() == 0
    assert {r.kept for r in L.identify(docs, None).collect()} == {False}


def test_labels_are_those_of_a_plain_network():
    """One byte after the other in plain Python, over whole texts that fit in a window."""
    g = random.Random(4)
    net = L.BiGRU(["a", "b", "c"], 4, 2)
    texts = [text(g, "fr", 6), "x", "", text(g, "de", 8)]
    mean, labels, size = L.label(net, pa.array(texts, pa.large_string()))
    clip = lambda x, a, b: max(a, min(b, x))
    for i, s in enumerate(texts):
        raw = s.encode()
        assert len(raw) <= L.WINDOW - 2 * L.CONTEXT
        out = np.tile(net.p["c"][:, 0].astype(float), (len(raw), 1))
        for d, order in (("f", range(len(raw))), ("b", range(len(raw) - 1, -1, -1))):
            W, R, V, h = (net.p["W" + d].astype(float), net.p["U" + d].astype(float), net.p["V" + d].astype(float), 4)
            s_ = [0.0] * h
            for t in order:
                x = [W[j][raw[t]] for j in range(3 * h)]
                u = [sum(R[j][k] * s_[k] for k in range(h)) for j in range(3 * h)]
                z = [clip((x[j] + u[j]) / 4 + 0.5, 0, 1) for j in range(2 * h)]
                n = [clip(x[2 * h + j] + z[h + j] * u[2 * h + j], -1, 1) for j in range(h)]
                s_ = [z[j] * s_[j] + (1 - z[j]) * n[j] for j in range(h)]
                out[t] += V @ s_
        p = np.exp(out - out.max(1, keepdims=True)) if len(raw) else out
        p = p / p.sum(1, keepdims=True) if len(raw) else p
        assert size[i] == len(raw) and np.allclose(mean[i], p.mean(0) if len(raw) else 0, atol=1e-4)
        assert labels[i].sum() == len(raw)
