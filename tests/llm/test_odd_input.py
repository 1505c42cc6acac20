"""Ids of other types, columns with clashing names, missing columns, numbers that are none, long words."""

import numpy as np
import pyarrow as pa

from tempoloom.llm import decontaminate, exact_dedup, language_id, near_dedup, quality, suffix_dedup
from tempoloom.llm import sentencepiece_codec as S

LONG = " ".join(f"p{i}" for i in range(80))


def test_clashing_names(spark):
    names = "_r_doc_id long, _gsa_spans string, _gsa_text long, _kmr_h long, _kmr_h_ string, _name long, bands long, bucket string"
    rows = [(i, LONG if i < 3 else f"text {i} of its own with words enough", i, "s", 1, 2, "h", 3, 4, "b") for i in range(6)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    bench = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(5, 30)))], "item_id long, text string")
    for kept, ids in ((exact_dedup.drop_copies(docs), {0, 3, 4, 5}), (near_dedup.drop_near_copies(docs), {0, 3, 4, 5}), (decontaminate.decontaminate(docs, bench), set(range(6)))):
        assert kept.columns == docs.columns
        got = kept.collect()
        assert {r.doc_id for r in got} >= ids - {4, 5} and all(r["_gsa_spans"] == "s" and r["_kmr_h_"] == "h" and r["_r_doc_id"] == r.doc_id for r in got)
    assert all("p5 " not in r.text for r in decontaminate.decontaminate(docs, bench).collect())


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", LONG), ("a", "x " + LONG), ("c", LONG + " y"), ("c", "short"), (None, LONG)], "doc_id string, text string")
    got = {tuple(r) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == {("b", 0, 79, "a", 1), ("c", 0, 79, "a", 1)}
    assert {(r.keep_id, r.doc_id) for r in near_dedup.near_copies(docs).collect()} == {("a", "b"), ("a", "c")}


def test_lengths_that_are_no_numbers_and_missing_languages(spark):
    docs = spark.createDataFrame([(1, "some text", "abc"), (2, "some text", "9"), (3, None, None)], "doc_id long, text string, n_chars string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score_all(docs, labels).count() == 3
    assert {r.lang_found for r in language_id.detect(docs).collect()} == {None}


def test_words_of_a_megabyte():
    m = S.load()
    w = "".join(chr(97 + i) for i in np.random.default_rng(1).integers(0, 26, 1_000_000))
    texts = pa.array([w, "a b", "", "é" * 40_000], pa.large_string())
    ids, offsets = S.encode(m, texts)
    assert S.decode(m, ids, offsets).to_pylist() == texts.to_pylist()
    data = np.frombuffer((" " + w[:5000]).encode(), np.uint8)
    old, S.BLOCK = S.BLOCK, 37
    try:
        assert S._long(m, data).tolist() == S._viterbi(m, data, np.array([0]), np.array([len(data)]))[0].tolist()
    finally:
        S.BLOCK = old
