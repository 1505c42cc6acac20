"""Quality classifier by co-training: a view of the text's content and a view of the page's metadata teach each other.

The text view sees hashed words and binned statistics of the text; the metadata view sees source, language, declared
length and their pairs. Both are linear classifiers. In each of ROUNDS rounds each view, calibrated, labels those of all
documents of which it is surest: at most PER_ROUND different ones of a class, only beyond SURE, and none that it has
labelled before. They join the other view's training set. In the end both views are calibrated on held-out labelled rows,
a logistic model of both calibrated log-odds combines them, and all documents are scored.

Texts are read once. Their features are kept in a checkpoint, four bytes for each distinct word of a document, and every
round scores this table and takes the surest rows task by task and then over all tasks, so no more than PER_ROUND rows of
a class reach the driver. Rows of equal features count as one. The labelled rows are a bounded sample by hash order
(LABELLED); nothing else is sampled.

Defined results: a null or empty text has no text features, so only its metadata speak; null metadata are a value of
their own; missing metadata columns and an n_chars that is no number count as null; labels with null or contradicting
quality, or without a document, are dropped; without labels of both classes every score is the share of good labels (0.5
without any); ties among the surest go by the hash of their features; repeated rows are scored one by one; a score of
just MIN_QUALITY is kept. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoloom.llm.common import checkpoint, hash_sample, text_slices
from tempoloom.llm.linear import fit, platt, scores, sigmoid
from tempoloom.llm.tokens import U, buffers, mix, shingles, words

LABELLED = 6000
ROUNDS, PER_ROUND, SURE = 4, 300, 0.95
HELD_OUT = 0.3
MIN_QUALITY = 0.5
WORDS, STATS, BINS, META = 1 << 14, 9, 12, 1 << 12
TEXT = WORDS + STATS * BINS

Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


UPPER, DIGIT, SPACE, LINE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(" \t\r\n"), _class("\n")
STOP, MARK = _class(".!?"), _class("!\"#$%&*+/<=>@\\^_`{|}~")


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return np.bincount(r[new], minlength=n)


def text_counts(texts: pa.Array) -> Sparse:
    """(row, feature, root of the count) of a large-string array without nulls, by row; 0 for the bins of statistics."""
    n, w = len(texts), words(texts)
    data, offsets = buffers(texts)
    size = np.maximum(np.diff(offsets), 1)

    def rate(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[data])])
        return (c[offsets[1:]] - c[offsets[:-1]]) / size

    total = np.bincount(w.row, minlength=n)
    row5, h5 = shingles(w, 5)
    mean = np.bincount(w.row, w.end - w.start, n) / np.maximum(total, 1) / 20
    stats = [rate(UPPER), rate(DIGIT), rate(SPACE), rate(LINE) * 10, rate(STOP) * 3, rate(MARK) * 3, mean, _distinct(w.row, w.hash, n) / np.maximum(total, 1), _distinct(row5, h5, n) / np.maximum(np.bincount(row5, minlength=n), 1)]
    there = np.flatnonzero(np.diff(offsets) > 0)
    bins = [WORDS + k * BINS + np.minimum(np.sqrt(np.clip(s[there], 0, 1)) * BINS, BINS - 1).astype(np.int64) for k, s in enumerate(stats)]
    at = (mix(w.hash + U(1)) % U(WORDS)).astype(np.int64)
    pairs, count = np.unique(w.row * WORDS + at, return_counts=True)
    row = np.concatenate([pairs // WORDS, *[there] * STATS])
    order = np.argsort(row, kind="stable")
    root = np.concatenate([np.sqrt(count), np.zeros(len(there) * STATS)]).astype(np.float16)
    return row[order], np.concatenate([pairs % WORDS, *bins])[order], root[order]


def valued(row: np.ndarray, feature: np.ndarray, root: np.ndarray, n: int) -> Sparse:
    """Words of a text share a norm of 1; a statistic's bin has 1/2."""
    r = root.astype(np.float64)
    norm = np.sqrt(np.bincount(row, r * r, n))
    return row, feature, np.where(r > 0, r / np.maximum(norm[row], 1e-9), 0.5)


def text_features(texts: pa.Array) -> Sparse:
    """(row, feature, value) of a large-string array without nulls."""
    return valued(*text_counts(texts), len(texts))


def meta_features(source: list, lang: list, n_chars: list) -> Sparse:
    """Hashed metadata and their pairs."""
    row, at = [], []
    for i, (s, x, n) in enumerate(zip(source, lang, n_chars)):
        size = None if n is None else int(n).bit_length() if n >= 0 else -1
        for j, key in enumerate((s, x, size, (s, x), (x, size))):
            row.append(i)
            at.append(_stable(f"{j}:{key}") % META)
    return np.array(row, np.int64), np.array(at, np.int64), np.full(len(row), 0.5)


@lru_cache(1 << 14)
def _stable(s: str) -> int:
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def take(x: Sparse, rows: np.ndarray, n: int) -> Sparse:
    """The given rows, renumbered in their order; a row may be given once."""
    new = np.full(n, -1, np.int64)
    new[rows] = np.arange(len(rows))
    keep = new[x[0]] >= 0
    return new[x[0][keep]], x[1][keep], x[2][keep]


@dataclass
class CoTrained:
    """Weights of both views, their calibrations (a, b), and the combination (text, metadata, bias)."""

    weights: tuple[np.ndarray, np.ndarray]
    calibration: tuple[tuple[float, float], tuple[float, float]]
    mixed: tuple[float, float, float]

    def view(self, k: int, x: Sparse, n: int) -> np.ndarray:
        a, b = self.calibration[k]
        return a * scores(self.weights[k], *x, n) + b

    def combined(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a, b, c = self.mixed
        return sigmoid(a * text + b * meta + c)


Taught = tuple[np.ndarray, np.ndarray, Sparse]
#: (weights, calibrations, keys that each view was taught) -> for each view the (keys, labels, other view's features) of the rows it teaches
Surest = Callable[[list, list, list], list[Taught]]


def surest_of(key: np.ndarray, p: np.ndarray, taught: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, probabilities) of the surest rows of class 0 and of class 1, each key once, surest first, ties by key."""
    out, new = [], ~np.isin(key, taught)
    for label in (0, 1):
        sure = p if label else 1 - p
        at = np.flatnonzero((sure >= SURE) & new)
        at = at[np.unique(key[at], return_index=True)[1]]
        at = at[np.lexsort((key[at], -sure[at]))][:PER_ROUND]
        out.append((key[at], sure[at]))
    return out


def in_memory(pool: tuple[Sparse, Sparse], n: int) -> Surest:
    """Teaches from rows that are all at hand; a row's number is its key."""

    def ask(w: list, cal: list, taught: list) -> list[Taught]:
        out: list[Taught] = []
        for k in (0, 1):
            p = sigmoid(cal[k][0] * scores(w[k], *pool[k], n) + cal[k][1])
            zero, one = surest_of(np.arange(n), p, taught[1 - k])
            keys = np.concatenate([zero[0], one[0]])
            out.append((keys, np.repeat([0.0, 1.0], [len(zero[0]), len(one[0])]), take(pool[1 - k], keys, n)))
        return out

    return ask


def cotrain(views: tuple[Sparse, Sparse], y: np.ndarray, pool: tuple[Sparse, Sparse] | Surest, n_pool: int = 0) -> CoTrained:
    """views and y: labelled rows in random order, of which the first HELD_OUT calibrate; pool: unlabelled rows, or who picks the surest."""
    n, dims = len(y), (TEXT, META)
    if not n or y.min() == y.max():
        share = float((y.sum() + 0.5) / (n + 1))
        return CoTrained(tuple(np.zeros(d + 1) for d in dims), ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0, float(np.log(share / (1 - share)))))  # type: ignore[arg-type]
    ask = pool if callable(pool) else in_memory(pool, n_pool)
    cut = max(1, int(n * HELD_OUT))
    held, used = np.arange(cut), np.arange(cut, n)
    sets = [[(take(views[k], used, n), y[used])] for k in (0, 1)]
    taught = [np.empty(0, np.int64), np.empty(0, np.int64)]
    w: list[np.ndarray] = []
    cal: list[tuple[float, float]] = []
    for rounds in range(ROUNDS + 1):
        w, cal = [], []
        for k, d in enumerate(dims):
            first = np.cumsum([0, *(len(t) for _, t in sets[k])])
            x = tuple(np.concatenate(c) for c in zip(*((r + i, f, v) for i, ((r, f, v), _) in zip(first.tolist(), sets[k]))))
            weight = np.full(first[-1], 0.5)
            weight[: len(used)] = 1
            w.append(fit(*x, np.concatenate([t for _, t in sets[k]]), d, weight))  # type: ignore[arg-type]
            cal.append(platt(scores(w[k], *take(views[k], held, n), cut), y[held]))
        if rounds == ROUNDS:
            break
        for k, (keys, label, x) in enumerate(ask(w, cal, taught)):
            sets[1 - k].append((x, label))
            taught[1 - k] = np.union1d(taught[1 - k], keys)
    out = CoTrained((w[0], w[1]), (cal[0], cal[1]), (1.0, 0.0, 0.0))
    logits = [out.view(k, take(views[k], held, n), cut) for k in (0, 1)]
    rows = np.tile(np.arange(cut), 2)
    mixed = fit(rows, np.repeat([0, 1], cut), np.concatenate(logits), y[held], 2, rounds=300, rate=0.1, l2=1e-3)
    return CoTrained(out.weights, out.calibration, (max(float(mixed[0]), 0.0), max(float(mixed[1]), 0.0), float(mixed[2])))


# --- features of all documents, packed: numbers of text features, roots of their counts, numbers of metadata features


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, source, lang, n_chars, y to doc_id, y, f, c, m."""
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            n = rows.num_rows
            row, feature, root = text_counts(texts)
            meta = meta_features(*(rows.column(k).to_pylist() for k in (2, 3, 4)))[1].astype(np.uint16)
            ends = np.searchsorted(row, np.arange(n + 1)) * 2
            binary = lambda data, at: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes())])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(5), binary(feature.astype(np.uint16), ends), binary(root, ends), binary(meta, np.arange(n + 1) * len(meta) * 2 // max(n, 1))], names=["doc_id", "y", "f", "c", "m"])


def _values(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many of each row) of a binary column."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(a):
        return np.empty(0, kind), np.empty(0, np.int64)
    a = a.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def unpacked(f: pa.Array, c: pa.Array, m: pa.Array) -> tuple[Sparse, Sparse]:
    n = len(f)
    feature, size = _values(f, np.uint16)
    meta, of_meta = _values(m, np.uint16)
    row = np.repeat(np.arange(n), size)
    return valued(row, feature.astype(np.int64), _values(c, np.float16)[0], n), (np.repeat(np.arange(n), of_meta), meta.astype(np.int64), np.full(len(meta), 0.5))


def _columns(batch: pa.RecordBatch | pa.Table, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(c)) for c in names]


def from_table(packed: DataFrame) -> Surest:
    """Teaches from the packed features of all documents; the hash of a row's features is its key."""
    spark = packed.sparkSession

    def ask(w: list, cal: list, taught: list) -> list[Taught]:
        shared = spark.sparkContext.broadcast((w, cal, taught))

        def surest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, cal, taught = shared.value
            best = {(k, label): (np.empty(0, np.int64), np.empty(0)) for k in (0, 1) for label in (0, 1)}
            for batch in batches:
                h, *columns = _columns(batch, "h", "f", "c", "m")
                key, n = h.to_numpy(), batch.num_rows
                for k, x in enumerate(unpacked(*columns)):
                    p = sigmoid(cal[k][0] * scores(w[k], *x, n) + cal[k][1])
                    for label, (keys, sure) in enumerate(surest_of(key, p, taught[1 - k])):
                        a, b = (np.concatenate(z) for z in zip(best[k, label], (keys, sure)))
                        at = np.unique(a, return_index=True)[1]
                        at = at[np.lexsort((a[at], -b[at]))][:PER_ROUND]
                        best[k, label] = a[at], b[at]
            for (k, label), (keys, sure) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), 2 * k + label, np.int32)), pa.array(keys), pa.array(np.round(sure, 9))], names=["kind", "h", "sure"])

        few = checkpoint(packed.select("h", "f", "c", "m").mapInArrow(surest, "kind int, h long, sure double"))  # PER_ROUND rows of a class, view and task
        tops = [few.filter(F.col("kind") == k).distinct().orderBy(F.desc("sure"), "h").limit(PER_ROUND) for k in range(4)]
        got = tops[0].union(tops[1]).union(tops[2]).union(tops[3]).select("kind", "h").toArrow()
        kind, key = (got.column(c).to_numpy() for c in ("kind", "h"))
        chosen = spark.createDataFrame(pa.table({"h": pa.array(np.unique(key), pa.int64())}), "h long")
        rows = packed.join(F.broadcast(chosen), "h").groupBy("h").agg(*[F.first(c).alias(c) for c in "fcm"]).toArrow().sort_by("h")
        views, known, out = unpacked(*_columns(rows, "f", "c", "m")), rows.column("h").to_numpy(), []
        for k in (0, 1):
            own = np.flatnonzero(kind // 2 == k)
            out.append((key[own], (kind[own] % 2).astype(float), take(views[1 - k], np.searchsorted(known, key[own]), len(known))))
        return out

    return ask


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "string")


def score_all(docs: DataFrame, labels: DataFrame, min_quality: float = MIN_QUALITY) -> DataFrame:
    """doc_id, text_score, meta_score, quality and kept of every document."""
    kinds = dict(docs.dtypes)
    number = F.expr("try_cast(n_chars as bigint)") if kinds.get("n_chars") in NUMBERS else F.lit(None).cast("long")
    own = docs.select("doc_id", "text", *[(F.col(c).cast("string") if c in kinds else F.lit(None).cast("string")).alias(c) for c in ("source", "lang")], number.alias("n_chars"))
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("_cot_y")).filter("low = _cot_y").drop("low")
    picked = checkpoint(hash_sample(known, LABELLED, known.count()).select("doc_id", F.col("_cot_y").cast("int").alias("_cot_y")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = own.join(F.broadcast(picked), "doc_id", "left").select("doc_id", "text", "source", "lang", "n_chars", "_cot_y")  # at most LABELLED rows
    packed = checkpoint(given.mapInArrow(_packed, f"doc_id {kind}, y int, f binary, c binary, m binary").withColumn("h", F.xxhash64("f", "c", "m")))
    rows = packed.filter("y is not null").dropDuplicates(["doc_id", "h"]).select(F.xxhash64("doc_id").alias("o"), "h", "y", "f", "c", "m").toArrow().sort_by([("o", "ascending"), ("h", "ascending")])
    model = cotrain(unpacked(*_columns(rows, "f", "c", "m")), rows.column("y").to_numpy().astype(float), from_table(packed))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            doc_id, *columns = _columns(batch, "doc_id", "f", "c", "m")
            text, meta = (m.view(k, x, batch.num_rows) for k, x in enumerate(unpacked(*columns)))
            q = m.combined(text, meta)
            yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(np.round(x, 6)) for x in (sigmoid(text), sigmoid(meta), q)), pa.array(q >= min_quality)], names=["doc_id", "text_score", "meta_score", "quality", "kept"])

    return packed.select("doc_id", "f", "c", "m").mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, quality double, kept boolean")
