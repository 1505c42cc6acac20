from pyspark.sql import functions as F

from tempoloom.functions import scoring, textfn, timefn, vectorfn
from tempoloom.operators import chunking


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_months(spark):
    bad = [None, "", "2024-13", "2024-00", "2024Q1", "2024-3", " 2024-05 "]
    got = spark.createDataFrame([(x,) for x in bad], "d string").select(timefn.parse_month(F.col("d")), timefn.month_index(F.col("d")), timefn.suffix(F.col("d"))).collect()
    assert [r[0] for r in got] == [None] * 6 + ["2024-05"]
    assert got[6][1] == 2024 * 12 + 5 and got[0][2] == got[1][2] == "TIME_UNKNOWN"
    assert timefn.expand(["2023-12"], "adjacent") == ["2023-11", "2023-12", "2024-01"]
    assert timefn.expand(["2023-11", "2024-02", "x"], "expanded") == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert timefn.validate(["2024-01", "2024-13"])[0] is False and timefn.validate([])[0] and not timefn.validate("2024-01")[0] and not timefn.validate([3])[0]


def test_times_in_names(spark):
    rows = [("r_2024Q1.txt", ""), ("Q4 2023 report.md", ""), ("x.txt", "made 2024-03-15 here"), ("a March 2024.txt", ""), ("b-2022.txt", ""), ("n.txt", "none")]
    df = spark.createDataFrame(rows, "p string, c string").withColumn("f", timefn.find_time(F.col("p"), F.col("c")))
    got = df.select("f", timefn.to_month(F.col("f"))).collect()
    assert [r[0] for r in got] == ["2024Q1", "2023Q4", "2024-03-15", "March2024", "2022", "UNKNOWN"]
    assert [r[1] for r in got] == ["2024-03", "2023-12", "2024-03", "2024-03", None, None]


def test_scores_worked_by_hand(spark):
    L = F.lit
    got = one(
        spark, scoring.mix(L(0.5), L(0.2)), scoring.relevance(L("2024-05"), ["2024-03"]), scoring.relevance(L(None).cast("string"), ["2024-03"]),
        scoring.neighbour(L(0.5), None, L(0.1), 0, L(False)), scoring.neighbour(L(0.5), None, L(0.1), 1, L(True)),
        scoring.edge(L(0.5), None, L(0.0), 0), scoring.edge(L(0.5), None, L(0.0), 1), scoring.connected_entity(L(0.5), None),
        scoring.edge_semantic(L(0.4), L(None).cast("double"), L("d")), scoring.edge_semantic(L(None).cast("double"), L(None).cast("double"), L("d")), scoring.edge_semantic(L(0.4), L(0.6), L("")), scoring.mix(L(0.7), L(0.1), 0, 0),
    )
    want = (0.38, 0.6, 0.0, 0.53, 0.5088, 0.64, 0.448, 0.56, 0.4, 0.3, 0.2, 0.7)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)), got


def test_vectors(spark):
    a, b, z = vectorfn.literal([1, 2, 2]), vectorfn.literal([2, 0, 0]), vectorfn.literal([0, 0, 0])
    got = one(spark, vectorfn.cosine(a, b), vectorfn.cosine(a, z), vectorfn.l2(a, b), vectorfn.squared_l2(a, b), vectorfn.norm(a))
    assert all(abs(x - y) < 1e-9 for x, y in zip(got, (1 / 3, 0, 3, 9, 3)))
    v = vectorfn.hashed("one two two")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and vectorfn.hashed("") == [0.0] * 64


def test_texts(spark):
    got = one(spark, textfn.clean(F.lit(" a  b\n")), textfn.sentences(F.lit("One. Two! three? Four")), textfn.truncate_tokens(F.lit("abcdefghijkl"), 2), textfn.document_of(F.lit("a_chunk_1_chunk_2")), textfn.token_count(F.lit(None).cast("string")), textfn.match_share(F.lit("An Apple"), ["apple", "pear"]))
    assert got == ("a b", ["One.", "Two! three?", "Four"], "abcdefgh...", "a", 0, 0.5)


def test_packing():
    count = lambda s: len(s.split())
    parts = ["a a a", "b b", "c c c c", "d", "e e e e e e e e e", "f"]
    out = chunking.pack(parts, count, 6, 2)
    assert out == [(0, "a a a b b", 5), (1, "b b c c c c", 6), (2, "d", 1), (3, "d e e e e e e e e e", 10), (4, "f", 1)]
    assert all(p in " ".join(x[1] for x in out) for p in parts)
    assert chunking.pack(["x " * 50], count, 6, 2) == [(0, "x " * 50, 50)] and chunking.pack([], count) == []


def test_windows_cover_the_text_and_end(spark):
    text = "".join(chr(97 + i % 26) for i in range(5003))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "doc_id long, text string")
    got = chunking.char_windows(docs).orderBy("doc_id", "chunk_index").collect()
    one_ = [r.content for r in got if r.doc_id == 1]
    assert one_[0] + "".join(x[200:] for x in one_[1:]) == text and [r.doc_id for r in got].count(2) == 1 and {r.doc_id for r in got} == {1, 2}
    words = spark.createDataFrame([(1, " ".join(map(str, range(1000))))], "doc_id long, text string")
    assert chunking.token_windows(words, 400, 100).count() == 3


def test_numbers_like_years_before_the_time(spark):
    names = {"rep_1900_2024-05.txt": "2024-05", "rep_2099_2024-12.MD": "2024-12", "1999 2024Q1.md": "2024Q1", "item 2001, March 2020": "March2020", "rep_1950_x.txt": "1950", "rep_1900_x_1951": "1900", "12345": "UNKNOWN"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.t for r in df.select("n", timefn.find_time(F.col("n"), F.lit("")).alias("t")).collect()} == names
    assert {r.n: r.t for r in df.select("n", timefn.find_time(F.lit("notes"), F.col("n")).alias("t")).collect()} == names
