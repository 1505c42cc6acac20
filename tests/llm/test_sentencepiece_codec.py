import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tempoloom.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def model():
    return S.load()


@pytest.fixture(scope="module")
def public():
    """The same pieces and scores as a unigram model of the public library."""
    data = open(S.MODEL, "rb").read()

    def varint(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    out = b""
    for number, x in S._fields(data):
        if number == 2:
            x += varint(3 << 3) + varint(1)  # the last model_type counts: 1 is unigram
        out += varint(number << 3 | 2) + varint(len(x)) + x
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def texts():
    g = random.Random(3)
    some = ["", " ", "   a  b ", "The quick brown fox", "Ünïcödé çà et là", "日本語テキスト 😀😀 x", "a\nb\tc\r\n", "0" * 5000, "x" + " " * 300 + "y", "▁marker", "é \u0000 ퟿ \U0010ffff"]
    some += ["".join(g.choice("abcdefghij ß漢😀 .,\n") for _ in range(g.randint(0, 200))) for _ in range(200)]
    return some + ["word " * 50000]


def test_same_as_the_public_library(model, public):
    t = texts()
    ids, offsets = S.encode(model, pa.array(t, pa.large_string()))
    for i, x in enumerate(t):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == public.encode(x), x[:50]
    assert S.decode(model, ids, offsets).to_pylist() == [x.replace(S.MARKER, " ") for x in t]


def test_best_path_against_brute_force(model):
    g = random.Random(5)
    piece = {model.text[a:b].tobytes(): k for k, (a, b) in enumerate(zip(model.offset, model.offset[1:])) if k not in set(model.byte) and b > a}
    for _ in range(60):
        x = "".join(g.choice("the andég 漢") for _ in range(g.randint(1, 25)))
        raw = (" " + x).encode()
        best = [0.0] + [-np.inf] * len(raw)
        for i in range(len(raw)):
            if raw[i] & 0xC0 == 0x80:
                continue
            n = next(j for j in range(i + 1, len(raw) + 1) if j == len(raw) or raw[j] & 0xC0 != 0x80)
            for j in range(i + 1, len(raw) + 1):
                s = model.score[piece[raw[i:j]]] if raw[i:j] in piece else model.unknown if j == n and raw[i:n] not in piece else -np.inf
                best[j] = max(best[j], best[i] + s)
        ids, _ = S.encode(model, pa.array([x], pa.large_string()))
        got, run = 0.0, 0
        byte = set(model.byte.tolist())
        for k in ids.tolist():
            if k in byte:
                b = model.text[model.offset[k]]
                run += 1
                got += model.unknown if b & 0xC0 != 0x80 else 0
            else:
                got += model.score[k]
        assert got == best[-1]


def test_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "a b", 3), (4, "x y", 4), (4, "x y", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted(((r.doc_id, r.n_ids, r.round_trip, r.text) for r in S.encoded(docs, with_text=True).collect()), key=str)
    assert got == sorted([(1, None, None, None), (2, 0, True, ""), (None, 2, True, "a b"), (4, 2, True, "x y"), (4, 2, True, "x y")], key=str)
    assert S.encoded(docs.limit(0)).count() == 0


def test_words_are_searched_once_for_all_batches(public, monkeypatch):
    m, searched, search = S.load(), [], S._in_parts
    monkeypatch.setattr(S, "_in_parts", lambda m, data, start, size: (searched.append(int(size.sum())), search(m, data, start, size))[1])
    t = [x for x in texts() if len(x) < 1000]
    for _ in range(2):
        ids, offsets = S.encode(m, pa.array(t, pa.large_string()))
        for i, x in enumerate(t):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == public.encode(x), x[:50]
    assert m.seen.size.max() <= S.SHORT and sum(searched[1:]) < searched[0] / 2  # longer words are searched again
    monkeypatch.setattr(S, "SEEN", len(m.seen.data) + 4)  # no room for more than a word or two
    for x in ["zq xv zqx zqv vqz", "xv zq and the", "zqx zqv"] * 2:
        x = pa.array([x], pa.large_string())
        assert S.encode(m, x)[0].tolist() == S.encode(replace(m, seen=S.Seen()), x)[0].tolist()
    assert len(m.seen.data) <= S.SEEN


def test_words_of_equal_hash_are_told_apart(public, monkeypatch):
    m = S.load()
    monkeypatch.setattr(S, "span_hash", lambda data, start, end: np.full(len(start), 7, np.uint64))
    for x in ("abc", "xyz", "abc", "abc xyz", "abcd"):
        assert S.encode(m, pa.array([x], pa.large_string()))[0].tolist() == public.encode(x)
