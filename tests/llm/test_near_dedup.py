import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tempoloom.llm import common as C
from tempoloom.llm import near_dedup as N
from tempoloom.llm.tokens import U

SCHEMA = "doc_id long, text string, comp long, bucket string"


def test_signatures_estimate_weighted_jaccard_without_bias():
    g = np.random.default_rng(0)
    for _ in range(3):
        el = g.integers(1, 2**63, 50).astype(U)
        wa = g.integers(0, 12, 50)
        wb = np.where(g.random(50) < 0.6, wa, g.integers(0, 12, 50))
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        row = np.repeat([0, 1], [(wa > 0).sum(), (wb > 0).sum()])
        s = N.signatures(row, np.concatenate([el[wa > 0], el[wb > 0]]), np.concatenate([wa[wa > 0], wb[wb > 0]]), 2, 6000)
        assert abs((s[0] == s[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 6000)


def make(seed, n=120):
    g = random.Random(seed)
    out = []
    for i in range(n):
        if out and g.random() < 0.6:
            t = g.choice(out).split()
            for _ in range(g.randint(0, max(1, len(t) // 6))):
                t[g.randrange(len(t))] = "e%d" % g.randrange(9999)
        else:
            t = ["v%d" % g.randrange(400) for _ in range(g.randint(4, 90))]
        out.append(" ".join(t))
    return out


def brute(texts):
    bag = []
    for t in texts:
        r, h, w = N.bags(pa.array([t], pa.large_string()))
        bag.append(np.repeat(h, w))
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if N.overlap(bag[a], bag[b]) >= N.THRESHOLD]
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return pairs, {i: top(i) for i in range(len(texts))}


def test_groups_against_brute_force(spark):
    hit = total = 0
    for seed in range(3):
        texts = make(seed)
        docs = spark.createDataFrame([(i, t, 0, "b") for i, t in enumerate(texts)], SCHEMA)
        got = {r.doc_id: r.keep_id for r in N.near_copies(docs).collect()}
        pairs, want = brute(texts)
        for a, b in pairs:
            total += 1
            hit += got.get(a, a) == got.get(b, b)
        assert all(want[a] == want[b] for a, b in got.items())
    assert total > 100 and hit >= 0.9 * total


def test_odd_rows(spark):
    long = " ".join("x%d" % (i % 5000) for i in range(200000))
    rows = [(1, None, 1, None), (2, None, 1, "a"), (3, "", 1, "a"), (4, "", 1, "a"), (5, "...", 1, "a"), (None, "one two three four", 1, "a"), (None, "one two three four", 1, "a"), (6, "One, two; three FOUR", 1, "a"), (7, "one two three four", 1, "a"), (8, "hi", None, None), (9, "Hi!", None, None), (10, long, 1, "z"), (11, long + " end", 1, "z"), (12, "six seven eight nine", 1, "a"), (12, "six seven eight nine", 1, "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, N.near_copies(docs).collect())) == [(6, 7), (8, 9), (10, 11)]
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] or -1 for r in kept.collect())) == [-1, -1, 1, 2, 3, 4, 5, 6, 8, 10, 12, 12]
    assert N.near_copies(docs.limit(0)).count() == 0


def union(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def test_components_on_the_driver_and_by_stars_with_salted_hubs(spark, monkeypatch):
    g = random.Random(5)
    pairs = [(0, i) for i in range(1, 60)] + [(g.randrange(100, 180), g.randrange(100, 180)) for _ in range(60)] + [(500, i) for i in range(400, 440)] + [(i, i + 1) for i in range(600, 640)]
    pairs = [(a, b) for a, b in pairs if a != b]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = union(pairs)
    assert {r.id: r.comp for r in C.components(edges).collect()} == want
    monkeypatch.setattr(C, "SMALL_EDGES", 0)
    monkeypatch.setattr(C, "HEAVY_ROWS", 10)
    assert {r.id: r.comp for r in C.components(edges).collect()} == want
    words = edges.select(*[F.concat(F.lit("k"), F.col(c).cast("string")).alias(c) for c in ("a", "b")])
    assert {r.id: r.comp for r in C.components(words).collect()} == union([(f"k{a}", f"k{b}") for a, b in pairs])


def test_a_hot_bucket_of_equal_and_nearly_equal_short_texts(spark, monkeypatch):
    """A group of most rows, with hubs, hot buckets and hot bags salted, and buckets of texts that aren't alike."""
    monkeypatch.setattr(C, "HEAVY_ROWS", 500)
    monkeypatch.setattr(C, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 10)
    near = [(i, f"please accept all the cookies of this site to go on reading number {i}") for i in range(3000)]
    rows = near + [(10000 + i, "the same short text again and again") for i in range(3000)] + [(20000 + i, f"w{i} x{i} y{i} z{i} v{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.keep_id for r in N.near_copies(docs).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {10000 + i: 10000 for i in range(1, 3000)}


def test_open_buckets_are_searched_through_by_pivots(spark, monkeypatch):
    """With one register a band every pair that shares a bucket is a candidate; all links between different texts are found."""
    monkeypatch.setattr(N, "PIVOTS", 2)
    texts = make(7, 60) + [f"a b c {x} {x}1 {x}2 {x}3" for x in "defghijklmnop"] + [f"a b c d e {x} {x}2" for x in "uvwxyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, want = brute(texts)
    monkeypatch.setattr(N, "band_hashes", lambda sig, bands=N.BANDS: (np.arange(N.BANDS) + np.zeros((len(sig), 1))).astype(np.int64) // 40)
    got = {r.doc_id: r.keep_id for r in N.near_copies(docs).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == want


def test_ids_of_any_type_and_columns_of_any_name(spark):
    rows = [(f"d{i}", t, "x", "y", "z", "w") for i, t in enumerate(["one two three four five", "One two three four five!", "six seven eight nine", None])]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _r_doc_id string, _salt string, bands string, _r_doc_id_ string")
    assert [tuple(r) for r in N.near_copies(docs).collect()] == [("d0", "d1")]
    kept = N.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {"d0", "d2", "d3"}


def test_similar_multisets_share_a_token_of_their_prefixes():
    g = np.random.default_rng(3)
    U = np.uint64
    for _ in range(3000):
        a, b = (np.sort(g.integers(0, g.integers(2, 30), g.integers(1, 25))).astype(U) for _ in range(2))
        count = g.integers(0, 4, 16)  # any order will do
        if N.overlap(a, b) >= N.THRESHOLD:
            x, y = (N.prefix(N._tokens(v), count) for v in (a, b))
            assert len(np.intersect1d(x, y))
        assert len(set(N._tokens(a).tolist())) == len(a)


def test_what_the_driver_holds_is_bounded_and_large_joins_shuffle_few_rows(spark, monkeypatch):
    assert C.BROADCAST_ROWS <= 100_000 and C.SMALL_EDGES <= 200_000
    monkeypatch.setattr(C, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(C, "FILTER_BITS", 1 << 16)
    big = spark.createDataFrame([(i if i % 50 else None, f"t{i}", i) for i in range(3000)], "doc_id long, text string, _bucket long")
    small = C.checkpoint(spark.createDataFrame([(i,) for i in range(0, 3000, 7)] + [(None,)], "doc_id long"))
    inside = {i for i in range(3000) if i % 50 == 0 or i % 7 == 0}
    for how, want in (("left_semi", inside), ("left_anti", set(range(3000)) - inside)):
        got = C.checked_join(big, small, ["doc_id"], how)
        assert got.columns == big.columns and sorted(r._bucket for r in got.collect()) == sorted(want)


def test_components_grow_by_what_is_new(spark):
    g = random.Random(8)
    first, more = ([(g.randrange(80), g.randrange(80, 160)) for _ in range(n)] for n in (40, 50))
    of = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    got = C.merged_components(C.components(of(first)), of(more))
    assert {r.id: r.comp for r in got.collect()} == union(first + more)
