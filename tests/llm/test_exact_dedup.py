import random

from tempoloom.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, n int, level string, _name long"


def test_against_brute_force_and_odd_rows(spark):
    g = random.Random(2)
    base = ["".join(g.choice("ab é") for _ in range(g.choice([0, 1, 3, 2047, 2048, 2049, 5000, 9000]))) for _ in range(25)]
    rows = [(i, g.choice(base), 1, "x", 2) for i in range(90)]
    rows += [(200, None, 1, "x", 2), (201, None, None, None, None), (None, base[0], 1, None, 1), (None, base[0], 1, None, 1), (3, rows[3][1], 7, "again", 9), (300, "z" * 300_000, 1, "l", 1), (301, "z" * 300_000, 1, "l", 1), (302, "z" * 299_999 + "y", 1, "l", 1), (303, "only", 1, "l", 1), (303, "only", 1, "l", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    group = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        group.setdefault(r[1], []).append(r[0])
    want = sorted(((v[0], x) for v in group.values() for x in v[1:]), key=str)
    assert sorted(map(tuple, E.exact_copies(docs).collect()), key=str) == want
    kept = E.drop_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.text for r in got if r.text is not None)) == sorted(group) and sum(r.text is None for r in got) == 2
    assert all(r.doc_id == group[r.text][0] for r in got if r.text is not None)
    assert E.exact_copies(docs.limit(0)).count() == 0
