import random

import numpy as np
import pyarrow as pa

from tempoloom.llm import decontaminate as D
from tempoloom.llm.tokens import words

SCHEMA = "doc_id long, text string, _name long, text2 string, n_chars long"


def brute(texts, items):
    """Word numbers to remove, by trying every run of words of every item."""
    tok = lambda t: ["".join(c for c in w) for w in "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in t).split()]
    items = [x for x in map(tok, items) if len(x) >= D.SHORT_WORDS]
    runs = {}
    for x in items:
        for i in range(len(x)):
            for j in range(i + D.SHORT_WORDS, len(x) + 1):
                k = tuple(x[i:j])
                runs[k] = min(runs.get(k, 1 << 60), len(x))
    out = []
    for t in texts:
        t, gone = tok(t), set()
        for i in range(len(t)):
            for j in range(i + D.SHORT_WORDS, len(t) + 1):
                n = runs.get(tuple(t[i:j]))
                if n is None:
                    break
                if j - i >= D.MIN_WORDS or j - i >= D.COVERAGE * n:
                    gone |= set(range(i, j))
        out.append(gone)
    return out


def corpus(seed):
    g = random.Random(seed)
    vocab = ["w%d" % i for i in range(4)] + ["é", "Ünder"]
    items = [" ".join(g.choice(vocab) for _ in range(g.randint(0, 30))) for _ in range(20)]
    texts = []
    for _ in range(60):
        t = [g.choice(vocab) for _ in range(g.randint(0, 40))]
        if g.random() < 0.7:
            x = g.choice(items).split()
            a = g.randint(0, len(x))
            t[g.randint(0, len(t)) : 0] = x[a : g.randint(a, len(x))]
        texts.append(", ".join(t))
    return texts, items


def test_longest_matches_agree_with_brute_force(spark):
    for seed in range(4):
        texts, items = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1, "x", len(t)) for i, t in enumerate(texts)], SCHEMA)
        bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
        got = {r.doc_id: {k for s in r.spans.split(",") for k in range(int(s.split("-")[0]), int(s.split("-")[1]) + 1)} for r in D.contaminated(docs, bench).collect()}
        want = {i: x for i, x in enumerate(brute(texts, items)) if x}
        assert got == want


def test_a_short_item_inside_a_longer_match(spark):
    short, long = "a b c d e f", "x y z a b c d e q " + " ".join(f"k{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "one x y z a b c d e r two", 1, "x", 1)], SCHEMA)
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    assert [tuple(r)[:5] for r in D.contaminated(docs, bench).collect()] == [(1, 5, "4-8", 11, 5)]
    assert brute(["one x y z a b c d e r two"], [short, long]) == [set(range(4, 9))]


def test_several_automata_give_the_same(spark, monkeypatch):
    texts, items = corpus(9)
    docs = spark.createDataFrame([(i, t, 1, "x", len(t)) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    one = sorted(map(tuple, D.contaminated(docs, bench).select("doc_id", "removed", "clean_text").collect()))
    monkeypatch.setattr(D, "SHARD_WORDS", 40)
    assert len(D.automata(bench)) > D.LINKS
    assert sorted(map(tuple, D.contaminated(docs, bench).select("doc_id", "removed", "clean_text").collect())) == one


def test_bytes_outside_spans_stay_and_odd_rows_pass(spark):
    item = " ".join(f"Word{i}" for i in range(20))
    rows = [(1, f"Début ici: {item.upper()}; la fin, bien. " + "and more words follow here to keep " * 4, 7, None, 3), (2, None, None, None, None), (None, "", 1, "y", 0), (3, item, 1, "y", 5), (4, "clean", 1, "z", 5), (4, "clean", 1, "z", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string")
    out = D.decontaminate(docs, bench)
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=str)
    clean = rows[0][1].replace(item.upper(), "")
    assert got == sorted([(1, clean, 7, None, len(clean)), *rows[1:3], *rows[4:]], key=str)  # 3 is dropped
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, empty).count() == len(rows)
    assert D.contaminated(docs.limit(0), bench).count() == 0


def test_very_long_text():
    item = [f"k{i}" for i in range(30)]
    a = D.build([words(pa.array([" ".join(item)], pa.large_string())).hash])
    w = words(pa.array([" ".join(["z y x"] * 200000 + item + ["q"] * 100000)], pa.large_string()))
    first, last, m = D.spans(a, w, D.bitmap(a.grams))
    assert (first.tolist(), last.tolist(), m.tolist()) == ([600000], [600029], [30])
    assert np.all(D.merged(np.array([5, 1]), np.array([7, 5]), np.array([3, 9]))[1] == [7])
