import random
from collections import defaultdict

import numpy as np

from tempoloom.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, part int, first long"


def brute(docs):
    """{doc_id: words of windows of SPAN words that occur earlier}, documents in order of (doc_id, text)."""
    seen, out = {}, defaultdict(set)
    for d, t in sorted(set(docs)):
        w = t.lower().split()
        for i in range(len(w) - S.SPAN + 1):
            k = tuple(w[i : i + S.SPAN])
            if seen.setdefault(k, (d, t, i)) != (d, t, i):
                out[d] |= set(range(i, i + S.SPAN))
    return dict(out)


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id] |= set(range(r.first, r.last + 1))
    return dict(out)


def make(seed):
    g = random.Random(seed)
    vocab = [f"w{i}" for i in range(g.choice([3, 40]))]
    text = lambda n: [g.choice(vocab) for _ in range(n)]
    shared = [text(g.randint(45, 140)) for _ in range(5)]
    docs = []
    for i in range(50):
        t = text(g.randint(0, 80))
        for _ in range(g.randint(0, 3)):
            x = g.choice(shared)
            a = g.randint(0, 5)
            t += x[a : len(x) - g.randint(0, 5)] + text(g.randint(0, 20))
        docs.append((i, " ".join(t)))
    docs += [(100 + i, docs[g.randrange(50)][1]) for i in range(6)]
    return docs + [(200, "a b " * 200), (201, "a b " * 120), (202, "same " * 130)]


def test_spans_against_brute_force(spark):
    for seed in range(3):
        docs = make(seed)
        rows = S.repeated_spans(spark.createDataFrame([(d, t, 1, 2) for d, t in docs], SCHEMA)).collect()
        text = {d: t.split() for d, t in docs}
        for r in rows:
            n = r.last - r.first + 1
            assert n >= S.SPAN and text[r.doc_id][r.first : r.last + 1] == text[r.keep_id][r.keep_first : r.keep_first + n]
            assert (r.keep_id, r.keep_first) < (r.doc_id, r.first)
        want = brute([d for d in docs if d[0] < 100 or d[0] >= 200])
        got = covered(r for r in rows if not 100 <= r.doc_id < 200)
        assert got == want
        assert all({r.doc_id for r in rows} >= {d} for d in range(100, 106) if len(text[d]) >= S.SPAN)


def test_ranks_sort_suffixes():
    g = np.random.default_rng(1)
    for _ in range(50):
        strings = [g.integers(1, 3, g.integers(1, 40)) for _ in range(6)]
        suffix = sorted({tuple(s[i:]) for s in strings for i in range(len(s))})
        true = {x: i + 1 for i, x in enumerate(suffix)}
        rank = lambda s, i: true[tuple(s[i:])] if i < len(s) else 0
        rows = []
        for s in strings:
            for i in range(len(s)):
                c = i % 3
                at = lambda j: s[j] if j < len(s) else 0
                rows.append((at(i), at(i + 1), c, rank(s, i + 1) if c == 0 else rank(s, i), rank(s, i + 1) if c == 1 else rank(s, i + 2), rank(s, i)))
        f = [np.array(x) for x in zip(*rows)]
        got = S.merge_ranks(*f[:5])
        order = np.argsort(got, kind="stable")
        assert np.all(np.diff(f[5][order]) >= 0)


def test_odd_rows(spark):
    long = " ".join(f"k{i % 7919}" for i in range(200000))
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(None, p, 1, 1), (1, None, 1, 1), (2, "", None, 1), (3, "", 1, 1), (4, p, 1, None), (4, p, 1, None), (5, "x " + p.upper() + ", y", 1, 1), (6, long, 1, 1), (7, long + " z", 1, 1), (8, "short", 1, 1), (8, "q " + p, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.first, r.last, r.keep_id) for r in S.repeated_spans(docs).collect()}
    assert {x[0] for x in got} == {5, 6, 7, 8}
    assert (5, 1, 60, 4) in got and (8, 1, 60, 4) in got
    assert S.repeated_spans(docs.limit(0)).count() == 0


def test_messages_of_many_partitions_travel_together():
    arrays = [np.arange(3, dtype=np.uint64), np.arange(2, dtype=np.uint8), np.empty(0, np.int64), np.arange(5, dtype=np.uint32)]
    data = S._pack(arrays)
    assert [(a.dtype, a.tolist()) for a in S._unpack(data)] == [(a.dtype, a.tolist()) for a in arrays]
    batches = list(S._batched((q, 7, data) for q in range(5000)))
    assert len(batches) == 1 and batches[0].column(0).to_pylist() == list(range(5000)) and batches[0].column(2)[4999].as_py() == data
    assert len(list(S._batched((0, 0, bytes(S.BATCH)) for _ in range(3)))) == 3 and not list(S._batched(iter(())))


def test_cuts_between_splitters():
    g = random.Random(2)
    for by in (1, 2):
        for kind in (np.uint32, np.uint64):
            keys = sorted(tuple(g.choice([0, 1, 5, 9, 2**32 - 1]) for _ in range(by)) for _ in range(60))
            splitters = sorted({tuple(g.choice([0, 1, 4, 5, 2**32 - 1]) for _ in range(by)) for _ in range(12)})
            assert S._cuts([np.array(f, kind) for f in zip(*keys)], splitters) == [sum(k < s for k in keys) for s in splitters]
    assert S._cuts([np.arange(3, dtype=np.uint64)], []) == []
