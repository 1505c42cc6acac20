import random

import numpy as np

from tempoloom.llm import toxicity as X


def corpus(n=900, seed=1):
    g = random.Random(seed)
    stems = ["zorb", "quax"]  # insults that no seed lexicon has
    rows = []
    for i in range(n):
        t = ["".join(g.choice(["an", "er", "lo", "mi", "ta"]) for _ in range(g.randint(1, 4))) for _ in range(g.randint(8, 80))]
        bad = g.random() < 0.2
        if bad:
            for _ in range(g.randint(1, 4)):
                t.insert(g.randrange(len(t)), g.choice(["idiot", "moron"]) if g.random() < 0.5 else g.choice(stems) + g.choice(["ig", "isch", "en", "ung"]))
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows] + [(None, None, 9), (5000, "", 9), (5001, None, None), (5002, "idiot " * 30000, 9), (5003, "you idiot moron", 9), (5003, "you idiot moron", 9)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 500] + [(3, 1, 0), (3, 1, 1), (None, 1, 1), (7, 0, None), (999999, 1, 1)], "doc_id long, quality int, toxic int")
    got = [r.doc_id for r in X.toxic_documents(docs, labels).collect()]
    want = {i for i, _, y in rows if y}
    held = {i for i in range(500, len(rows))}
    assert len(held & want & set(got)) >= 0.95 * len(held & want)
    assert len((held - want) & set(got)) <= 0.01 * len(held - want)
    assert 5002 in got and got.count(5003) == 2 and not {None, 5000, 5001} & set(got)
    assert X.toxic_documents(docs.limit(0), labels).count() == 0
    seeds = {r.doc_id for r in X.toxic_documents(docs, labels.limit(0)).collect()}
    assert 5002 in seeds and not (held - want) & seeds


def test_label_model_finds_accuracies_and_correlations():
    g = np.random.default_rng(2)
    y = g.random(20000) < 0.15
    flip = lambda p, q: np.where(y, g.random(len(y)) < p, g.random(len(y)) < q)
    v = np.stack([flip(0.9, 0.02), flip(0.7, 0.01), flip(0.5, 0.05), flip(0.8, 0.02), flip(0.6, 0.03), flip(0.85, 0.05)], 1)
    v = np.concatenate([v, v[:, 4:5] ^ (g.random((len(y), 1)) < 0.02), flip(0.6, 0.02)[:, None]], 1)
    pattern, count = np.unique(v, axis=0, return_counts=True)
    m = X.label_model(pattern, count)
    true = [(v[:, j] == y).mean() for j in range(v.shape[1])]
    assert np.abs(m.accuracy - true).max() < 0.03
    assert any({4, 6} <= set(b) for b in m.blocks)
    assert ((m.posterior(v.astype(np.int64)) > 0.5) == y).mean() > 0.98


def test_posterior_is_that_of_bayes_rule():
    m = X.LabelModel([[0, 2], [1]], [np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.2, 0.3, 0.4]]), np.array([[0.9, 0.1], [0.4, 0.6]])], 0.2, np.empty(0), np.empty(0))
    v = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    for row, got in zip(v, m.posterior(v)):
        joint = [p * m.table[0][y][row[0] + 2 * row[2]] * m.table[1][y][row[1]] for y, p in ((0, 0.8), (1, 0.2))]
        assert abs(got - joint[1] / sum(joint)) < 1e-12
