"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Both directions run gates with piecewise-linear activations, ``z, r = clip(x / 4 + 1/2, 0, 1)`` and
``n = clip(x, -1, 1)``, so that reading whole corpora stays in a few array operations a byte. The network labels every
byte; a document's probabilities are the means over all its bytes. Texts are read whole, as windows that overlap by
CONTEXT bytes on each side, each position being labelled in one window.

Training uses a bounded sample: TRAIN_DOCS labelled documents by hash order (a documented parameter; it doesn't grow
with the corpus). All documents are then labelled.

Defined results: a null or empty text has no bytes, so its lang and prob are null and it is rejected; a document is kept
if its best mean probability is at least MIN_PROB. Ties go to the first language in code order. Repeated rows are
labelled one by one. An empty table, one without a labelled language or without a column lang gives null languages. Other
columns pass
untouched in ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempoloom.llm.common import text_slices
from tempoloom.llm.tokens import buffers

TRAIN_DOCS = 1500
STEPS = 500
HIDDEN = 8
WINDOW, CONTEXT = 256, 16
MIN_PROB = 0.5
SEED = 11


def sample(docs: DataFrame, n: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """About n (lang, text) rows by hash of doc_id; the whole table's count sets the share that is taken."""
    if "lang" not in docs.columns:
        return []
    usable = docs.select("doc_id", "lang", "text").filter("lang is not null and text <> ''")
    total = docs.filter("lang is not null").count()
    share = min(1.0, 1.2 * n / max(total, 1))
    taken = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    rows = taken.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(n).select("lang", "text").collect()
    return [(r[0], r[1]) for r in rows]


class BiGRU:
    """Weights of both directions: W (3H, 257) for bytes (256 pads), U (3H, H), V (L, H), c (L)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        g, h, n = np.random.default_rng(seed), hidden, len(langs)
        self.langs, self.hidden, self.p = langs, h, {}
        for d in "fb":
            self.p["W" + d] = g.normal(0, 0.3, (3 * h, 257)).astype(np.float32)
            self.p["W" + d][:h] += 1  # gates start open, so that states last
            self.p["U" + d] = g.normal(0, 0.4 / np.sqrt(h), (3 * h, h)).astype(np.float32)
            self.p["V" + d] = g.normal(0, 0.3, (n, h)).astype(np.float32)
        self.p["c"] = np.zeros((n, 1), np.float32)

    def states(self, d: str, ids: np.ndarray, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(t, state of shape (H, B)) in the direction's order. ids: (steps, B), 256 where there is no byte."""
        h = self.hidden
        W, U = np.ascontiguousarray(self.p["W" + d].T), self.p["U" + d]
        steps, b = ids.shape
        s, a, u = np.zeros((h, b), np.float32), np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32)
        padded = (ids == 256).any(1)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.matmul(U, s, out=u)
            np.copyto(a, np.take(W, ids[t], axis=0).T)
            zr = a[: 2 * h]
            zr += u[: 2 * h]
            zr *= 0.25
            zr += 0.5
            np.minimum(zr, 1, out=zr)
            np.maximum(zr, 0, out=zr)
            n = a[2 * h :]
            un = u[2 * h :]
            if keep is not None:
                keep.append((t, s.copy(), zr.copy(), un.copy(), None))
            un *= zr[h:]
            n += un
            np.minimum(n, 1, out=n)
            np.maximum(n, -1, out=n)
            if keep is not None:
                keep[-1] = (*keep[-1][:4], n.copy())
            s -= n
            s *= zr[:h]
            s += n
            if padded[t]:
                s *= ids[t] != 256
            yield t, s

    def logits(self, ids: np.ndarray) -> np.ndarray:
        out = np.empty((ids.shape[0], len(self.langs), ids.shape[1]), np.float32)
        for t, s in self.states("f", ids):
            np.matmul(self.p["Vf"], s, out=out[t])
        for t, s in self.states("b", ids):
            out[t] += self.p["Vb"] @ s
        out += self.p["c"]
        return out

    def probs(self, ids: np.ndarray) -> np.ndarray:
        x = self.logits(ids)
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def gradient(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes, and its gradient by backpropagation through time. y: (B), a class for each window."""
        h, kept = self.hidden, {"f": [], "b": []}
        steps, b = ids.shape
        out = np.zeros((steps, len(self.langs), b), np.float32)
        st = {}
        for d in "fb":
            st[d] = np.empty((steps, h, b), np.float32)
            for t, s in self.states(d, ids, kept[d]):
                st[d][t] = s
                out[t] += self.p["V" + d] @ s
        out += self.p["c"]
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        live = ids != 256
        total = max(1, int(live.sum()))
        right = out[:, y, np.arange(b)]
        loss = float(-(np.log(np.maximum(right, 1e-9)) * live).sum() / total)
        out[:, y, np.arange(b)] -= 1
        out *= live[:, None, :] / np.float32(total)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"] = out.sum((0, 2)).reshape(-1, 1)
        for d in "fb":
            U, V = self.p["U" + d], self.p["V" + d]
            ds = np.zeros((h, b), np.float32)
            for t, s0, zr, un, n in reversed(kept[d]):
                g["V" + d] += out[t] @ st[d][t].T
                ds += V.T @ out[t]
                ds *= live[t]
                z, r = zr[:h], zr[h:]
                dn = ds * (1 - z)
                dn *= (n > -1) & (n < 1)
                da = np.empty((3 * h, b), np.float32)
                da[:h] = ds * (s0 - n) * 0.25
                da[h : 2 * h] = dn * un * 0.25
                da[: 2 * h] *= (zr > 0) & (zr < 1)
                da[2 * h :] = dn
                for k in range(3 * h):
                    g["W" + d][k] += np.bincount(ids[t], da[k], 257).astype(np.float32)
                da[2 * h :] *= r
                g["U" + d] += da @ s0.T
                ds = ds * z + U.T @ da
        return loss, g


def train(rows: list[tuple[str, str]], steps: int = STEPS, batch: int = 192, length: int = 48, seed: int = SEED) -> BiGRU | None:
    """Adam on random windows of the sample, languages drawn evenly."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    net, g = BiGRU(langs, seed=seed), np.random.default_rng(seed)
    texts = [[np.frombuffer(t.encode(), np.uint8) for lang, t in rows if lang == x] for x in langs]
    weight = [np.cumsum([len(t) for t in ts]) for ts in texts]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        y = np.arange(batch) % len(langs)
        ids = np.full((length, batch), 256, np.int64)
        for j, c in enumerate(y):
            at = g.integers(weight[c][-1])
            t = texts[c][int(np.searchsorted(weight[c], at, "right"))]
            first = int(g.integers(max(1, len(t) - length + 1)))
            piece = t[first : first + length]
            ids[: len(piece), j] = piece
        _, grad = net.gradient(ids, y)
        norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
        rate = 0.02 * min(1, step / 30) * (1 - 0.95 * step / steps)
        for k, x in grad.items():
            x = x / max(1, norm)
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: BiGRU, texts: pa.Array, window: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a large-string array: mean probabilities (n, L), positions labelled with each language (n, L), bytes (n)."""
    data, offsets = buffers(texts)
    size = np.diff(offsets)
    core, k = window - 2 * context, len(net.langs)
    count = -(-size // core)
    row = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = offsets[row] + at * core
    last = np.minimum(first + core, offsets[row + 1])
    total, labels = np.zeros((len(size), k)), np.zeros((len(size), k), np.int64)
    order = np.argsort(first - last, kind="stable")  # long windows first, so that short ones share short batches
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    for i in range(0, len(order), 4096):
        w = order[i : i + 4096]
        a, b = first[w], last[w]
        low, high = np.maximum(a - context, offsets[row[w]]), np.minimum(b + context, offsets[row[w] + 1])
        steps = int((high - a).max()) + context
        pos = a[None, :] - context + np.arange(steps)[:, None]
        inside = (pos >= low) & (pos < high)
        ids = padded[np.where(inside, pos, len(data))].astype(np.int64)
        ids[~inside] = 256
        p = net.probs(ids)
        counted = (pos >= a) & (pos < b)
        best = p.argmax(1)
        p *= counted[:, None, :]
        for c in range(k):
            total[:, c] += np.bincount(row[w], p[:, c].sum(0), len(size))
            labels[:, c] += np.bincount(row[w], ((best == c) & counted).sum(0), len(size)).astype(np.int64)
    return total / np.maximum(size, 1)[:, None], labels, size


def identify(docs: DataFrame, net: BiGRU | None, keep_columns: bool = False, min_prob: float = MIN_PROB) -> DataFrame:
    """doc_id, lang_found, prob, positions (labelled bytes by language), kept; or with keep_columns the rows of docs that stay."""
    schema = docs.schema if keep_columns else T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("lang_found", T.StringType()), ("prob", T.DoubleType()), ("positions", T.MapType(T.StringType(), T.LongType())), ("kept", T.BooleanType())))])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((net.langs, net.p) if net else None)  # a few thousand floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        if shared.value:
            net = BiGRU(shared.value[0])
            net.p = shared.value[1]
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                n = rows.num_rows
                if net is None:
                    mean, labels, size = np.zeros((n, 1)), np.zeros((n, 1), np.int64), np.zeros(n, np.int64)
                else:
                    mean, labels, size = label(net, texts)
                best, prob = mean.argmax(1), mean.max(1)
                kept = (size > 0) & (prob >= min_prob)
                if keep_columns:
                    yield rows.filter(pa.array(kept))
                    continue
                none = size == 0
                names = pa.array([None if none[i] or net is None else net.langs[best[i]] for i in range(n)], pa.string())
                counts = pa.array([[(net.langs[c], int(x)) for c, x in enumerate(r) if x] if net else [] for r in labels], pa.map_(pa.string(), pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), names, pa.array(np.round(prob, 6), mask=none), counts, pa.array(kept)], names=[f.name for f in schema])

    return (docs if keep_columns else docs.select("doc_id", "text")).mapInArrow(run, schema)


def detect(docs: DataFrame) -> DataFrame:
    """Train on the bounded sample, then label every document."""
    return identify(docs, train(sample(docs)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is found with MIN_PROB or more, all columns untouched."""
    return identify(docs, train(sample(docs)), keep_columns=True)
