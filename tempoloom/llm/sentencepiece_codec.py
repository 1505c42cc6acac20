"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

Pieces, scores and normaliser settings are read from a model file, which is never trained or changed here; the path is
a parameter (a model of a public tokenizer by default). A score is taken as the piece's log score. White space is a
marker at the front of pieces, and each text has one marker put before it. If no piece has a marker after another
character (checked on loading), the best path of a text is that of its words one by one, so each batch encodes its
distinct words once, and a process keeps the ids of up to SEEN bytes of short words for its later batches and tasks (equal
by their bytes, not only by hash; what doesn't fit is searched again); otherwise whole texts are searched. A character that no piece holds alone has a node scored
10 below the least score, and is written as its UTF-8 bytes.

Ties go to the path whose last piece starts first, as in the public implementation. The trie is built on the driver and
broadcast: it is as large as the vocabulary, not the corpus.

Defined results: a null text has null ids and null decoded text; an empty text has no ids. Decoding gives the text back
exactly, save the marker character itself (U+2581), which is read as a space. Repeated rows are encoded one by one;
other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tempoloom.llm.common import text_slices
from tempoloom.llm.tokens import buffers, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
PART = 1 << 16  # bytes of words whose lattice is searched at once
BLOCK = 1 << 14  # bytes of a longer word whose lattice is searched at once
SLICE = 1 << 19  # bytes of text that are encoded at once
SEEN = 1 << 22  # bytes of words whose ids a process keeps
SHORT = 64  # bytes of the longest word that is kept
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
            yield tag >> 3, value
            continue
        n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
        yield tag >> 3, data[i : i + n]
        i += n


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans, one span after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Seen:
    """Words with their ids, in the order of their hashes."""

    def __init__(self) -> None:
        self.hash, self.data, self.ids = np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int32)
        self.start, self.size, self.first, self.count = (np.empty(0, np.int32) for _ in range(4))  # of the word in data, of its ids in ids

    def find(self, names: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words are here, where these are)."""
        at = np.minimum(np.searchsorted(self.hash, names), len(self.hash) - 1)
        here = np.flatnonzero((self.hash[at] == names) & (self.size[at] == size)) if len(self.hash) else np.empty(0, np.int64)
        at, n = at[here], size[here]
        differ = data[_flat(start[here], n)] != self.data[_flat(self.start[at].astype(np.int64), n)]
        if differ.any():  # hashes met
            same = np.ones(len(here), bool)
            same[np.repeat(np.arange(len(here)), n)[differ]] = False
            here, at = here[same], at[same]
        return here, at

    def add(self, names: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Words that aren't here, in the order of their hashes, with the ids of one after the other; as many as there is room for."""
        fits = size <= SHORT
        fits &= len(self.data) + np.cumsum(size * fits) <= SEEN
        if not fits.any():
            return
        first = (np.cumsum(count) - count)[fits]
        names, start, size, count = names[fits], start[fits], size[fits], count[fits]
        at = np.searchsorted(self.hash, names)
        for name, x in (("hash", names), ("start", len(self.data) + np.cumsum(size) - size), ("size", size), ("first", len(self.ids) + np.cumsum(count) - count), ("count", count)):
            old = getattr(self, name)
            setattr(self, name, np.insert(old, at, x.astype(old.dtype)))
        self.data = np.concatenate([self.data, data[_flat(start, size)]])
        self.ids = np.concatenate([self.ids, ids[_flat(first, count)].astype(np.int32)])


@dataclass
class Model:
    """base, check and value make the double array: a child by byte b of node s is base[s] + b if check there is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece of a node, or -1
    score: np.ndarray  # of the pieces
    unknown: float
    byte: np.ndarray  # ids of the 256 byte pieces
    text: np.ndarray  # bytes of all pieces as decoded
    offset: np.ndarray
    by_word: bool
    longest: int  # bytes of the longest piece
    seen: Seen = field(default_factory=Seen)


def trie(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array over byte strings. Nodes are placed breadth first, each at the first base where all its children fit."""
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for w, k in words:
        s = 0
        for b in w:
            t = children[s].get(b)
            if t is None:
                t = children[s][b] = len(children)
                children.append({})
                ids.append(-1)
            s = t
        ids[s] = k
    size = len(children) * 2 + 1024
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    free = np.ones(size, bool)
    free[0] = False
    value[0] = ids[0]
    queue, low = [(0, 0)], 1
    for s, at in queue:
        if not children[s]:
            continue
        keys = np.array(sorted(children[s]))
        while low < size and not free[low]:
            low += 1
        start = max(low - int(keys[0]), 1)
        while True:
            if start + 4096 + 256 >= size:
                more = size
                base, check, value = (np.concatenate([a, np.full(more, x, np.int64)]) for a, x in ((base, 0), (check, -1), (value, -1)))
                free = np.concatenate([free, np.ones(more, bool)])
                size += more
            fits = np.ones(4096, bool)
            for k in keys:
                fits &= free[start + k : start + k + 4096]
            if fits.any():
                b = start + int(fits.argmax())
                break
            start += 4096
        base[at] = b
        free[b + keys] = False
        check[b + keys] = at
        for k in keys.tolist():
            t = children[s][k]
            value[b + k] = ids[t]
            queue.append((t, b + k))
    return base, check, value


def load(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        data = f.read()
    pieces, settings = [], {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
    for number, x in _fields(data):
        if number == 1:
            p = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(x))
            pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0], p[3]))
        elif number == 3:
            settings |= dict(_fields(x))
    if settings[2] or settings[4] or not settings[3] or not settings[5]:
        raise ValueError("only models that change no character, keep white space and put a marker first are read")
    byte = np.array([k for k, (_, _, kind) in enumerate(pieces) if kind == BYTE])
    if len(byte) != 256:
        raise ValueError("the model has no byte pieces")
    plain = [(p.replace(MARKER, " ").encode(), k) for k, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
    score = np.array([s for _, s, _ in pieces], np.float64)
    shown = [bytes([byte.searchsorted(k)]) if kind == BYTE else b"" if kind in (UNKNOWN, CONTROL) else p.replace(MARKER, " ").encode() for k, (p, _, kind) in enumerate(pieces)]
    by_word = not any(b" " in p.lstrip(b" ") for p, _ in plain)
    least = min(score[k] for _, k in plain)
    return Model(*trie(plain), score, float(least) - 10, byte, np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0, *map(len, shown)]), by_word, max(len(p) for p, _ in plain))


def _lattice(m: Model, data: np.ndarray, head: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, piece or -1, log score) of the pieces that start at the characters ``head`` and end by ``stop``, and each character's end."""
    n = len(data)
    pos, node, at = head, np.zeros(len(head), np.int64), head
    ends, begins, which = [], [], []
    while len(at):
        to = m.base[node] + data[at]
        to[to >= len(m.check)] = 0
        ok = m.check[to] == node
        pos, node, at = pos[ok], to[ok], at[ok] + 1
        hit = m.value[node] >= 0
        begins.append(pos[hit])
        ends.append(at[hit])
        which.append(m.value[node[hit]])
        more = at < stop[pos]
        pos, node, at = pos[more], node[more], at[more]
    b0, e0, k0 = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, ends, which))
    width = np.where(data[head] < 0x80, 1, np.where(data[head] < 0xE0, 2, np.where(data[head] < 0xF0, 3, 4)))
    last = np.zeros(n + 1, np.int64)
    last[head] = head + width
    single = np.zeros(n + 1, bool)
    single[b0[e0 == last[b0]]] = True
    alone = ~single[head]
    k = np.concatenate([k0, np.full(alone.sum(), -1)])
    return np.concatenate([b0, head[alone]]), np.concatenate([e0, last[head[alone]]]), k, np.where(k >= 0, m.score[k], m.unknown), last


def _long(m: Model, data: np.ndarray) -> np.ndarray:
    """Ids of one long span: its lattice is built and searched in blocks of BLOCK bytes, with the scores of one piece's length ahead."""
    n, reach = len(data), max(m.longest, 4)
    back, came = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    ahead = [0.0] + [-np.inf] * (BLOCK + reach)  # best scores from the block's first byte on
    for a in range(0, n, BLOCK):
        part = data[a : min(n, a + BLOCK + reach)]
        own = part[: min(BLOCK, n - a)]
        b, e, k, gain, _ = _lattice(m, part, np.flatnonzero((own & 0xC0) != 0x80), np.full(len(part), len(part)))
        order = np.argsort(b, kind="stable")
        for i, j, piece, g in zip(b[order].tolist(), e[order].tolist(), k[order].tolist(), gain[order].tolist()):
            x = ahead[i] + g
            if x > ahead[j]:
                ahead[j], back[a + j], came[a + j] = x, a + i, piece
        ahead = ahead[BLOCK:] + [-np.inf] * BLOCK
    ids, at = [], n
    while at:
        p, piece = int(back[at]), int(came[at])
        ids.append([piece] if piece >= 0 else m.byte[data[p:at]].tolist())
        at = p
    return np.array([x for piece in reversed(ids) for x in piece], np.int64)


def _viterbi(m: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best ids of disjoint spans of data, in order, and the count of ids of each span."""
    n = len(data)
    owner = np.full(n, -1, np.int64)
    stop = np.zeros(n, np.int64)
    size = end - start
    flat = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    owner[flat] = np.repeat(np.arange(len(start)), size)
    stop[flat] = np.repeat(end, size)
    b, e, k, gain, last = _lattice(m, data, flat[(data[flat] & 0xC0) != 0x80], stop)
    depth = b - start[owner[b]]
    order = np.argsort(depth, kind="stable")
    b, e, k, gain, depth = b[order], e[order], k[order], gain[order], depth[order]
    best, back, came = np.full(n + 1 + len(start), -np.inf), np.zeros(n + 1 + len(start), np.int64), np.zeros(n + 1 + len(start), np.int64)
    # a span's end is the next span's start, so ends have cells of their own
    begin_cell = b
    end_cell = np.where(e == stop[b], n + 1 + owner[b], e)
    best[start[size > 0]] = 0
    cuts = np.flatnonzero(np.diff(depth)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):  # all that start so deep in their spans end in different cells
        x = best[begin_cell[i:j]] + gain[i:j]
        won = np.flatnonzero(x > best[end_cell[i:j]])
        cell = end_cell[i:j][won]
        best[cell], back[cell], came[cell] = x[won], b[i:j][won], k[i:j][won]
    spans = np.flatnonzero(size > 0)
    cell, origin = n + 1 + spans, start[spans]
    got_b, got_k = [], []
    while len(cell):
        p = back[cell]
        got_b.append(p)
        got_k.append(came[cell])
        more = p > origin
        cell, origin = p[more], origin[more]
    b = np.concatenate(got_b) if got_b else np.empty(0, np.int64)
    k = np.concatenate(got_k) if got_k else np.empty(0, np.int64)
    # spans may lie in any order; ids go by span, then by place
    order = np.lexsort((b, owner[b]))
    b, k = b[order], k[order]
    count = np.where(k >= 0, 1, last[b] - b)
    at = np.repeat(b, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    ids = np.repeat(k, count)
    raw = ids < 0
    ids[raw] = m.byte[data[at[raw]]]
    return ids, np.bincount(owner[b], count, len(start)).astype(np.int64)


def _in_parts(m: Model, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_viterbi over spans packed into parts of about PART bytes, so that the lattice stays small; a longer span by itself."""
    part, large = (np.cumsum(size) - size) // PART, size > PART
    bounds = np.flatnonzero((np.diff(part) > 0) | large[1:] | large[:-1]) + 1
    ids, counts = [], []
    for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(start)]):
        if large[a]:
            ids.append(_long(m, data[start[a] : start[a] + size[a]]))
            counts.append(np.array([len(ids[-1])]))
            continue
        n = size[a:b]
        begin = np.cumsum(n) - n
        packed = data[np.repeat(start[a:b] - begin, n) + np.arange(n.sum())]
        x, c = _viterbi(m, packed, begin, begin + n)
        ids.append(x)
        counts.append(c)
    return np.concatenate(ids), np.concatenate(counts)


def _distinct(m: Model, names: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_in_parts over spans of different hashes, in the order of these; only those that weren't seen are searched."""
    here, at = m.seen.find(names, data, start, size)
    new = np.ones(len(names), bool)
    new[here] = False
    count = np.empty(len(names), np.int64)
    count[here] = m.seen.count[at]
    searched = _in_parts(m, data, start[new], size[new]) if new.any() else None
    if searched:
        count[new] = searched[1]
    begin = np.cumsum(count) - count
    ids = np.empty(count.sum(), np.int64)
    ids[_flat(begin[here], count[here])] = m.seen.ids[_flat(m.seen.first[at].astype(np.int64), count[here])]
    if searched:
        ids[_flat(begin[new], count[new])] = searched[0]
        m.seen.add(names[new], data, start[new], size[new], *searched)
    return ids, count


def encode(m: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets) for a large-string array without nulls."""
    texts = pc.replace_substring(texts, MARKER, " ")
    some = pc.greater(pc.binary_length(texts), 0)
    marked = pc.if_else(some, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())), texts)
    data, offsets = buffers(marked.combine_chunks() if isinstance(marked, pa.ChunkedArray) else marked)
    n = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    head = np.zeros(len(data), bool)
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    if m.by_word:
        space = data == 32
        head[1:] |= space[1:] & ~space[:-1]
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(data))
    names, first, which = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    size = end - start
    same = np.arange(len(data)) + np.repeat(start[first][which] - start, size)
    if not (np.array_equal(size, size[first][which]) and np.array_equal(data[same], data)):  # hashes met
        first, which = np.arange(len(start)), np.arange(len(start))
        ids, count = _in_parts(m, data, start, size)
    else:
        ids, count = _distinct(m, names, data, start[first], size[first])
    begin = np.cumsum(count) - count
    n_ids = count[which]
    flat = np.repeat(begin[which], n_ids) + np.arange(n_ids.sum()) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)
    total = np.concatenate([[0], np.cumsum(n_ids)])
    return ids[flat], total[np.searchsorted(start, offsets)]


def decode(m: Model, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Large strings; bytes that are no UTF-8 are replaced."""
    size = m.offset[ids + 1] - m.offset[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = m.text[np.repeat(m.offset[ids], size) + np.arange(ends[-1]) - np.repeat(ends[:-1], size)] if len(ids) else np.empty(0, np.uint8)
    bounds = ends[offsets]
    marked = (np.diff(bounds) > 0).astype(np.int64)
    marked[marked > 0] = data[bounds[:-1][marked > 0]] == 32  # the marker put first
    keep = np.ones(len(data), bool)
    keep[bounds[:-1][marked > 0]] = False
    out = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((bounds - np.concatenate([[0], np.cumsum(marked)])).astype(np.int64)), pa.py_buffer(data[keep].tobytes())])
    try:
        return out.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace") for x in out.to_pylist()], pa.large_string())


def encoded(docs: DataFrame, path: str = MODEL, with_text: bool = False) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (whether decoding the ids gives the text back); with_text adds the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    fields = [docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*fields, *([T.StructField("text", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, texts in text_slices(batch, "text", SLICE):
                ids, offsets = encode(m, texts)
                back = decode(m, ids, offsets)
                null = np.array(rows.column(rows.schema.get_field_index("text")).is_null())
                nulls = pa.array(null)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                cols = [rows.column(rows.schema.get_field_index("doc_id")), pc.if_else(nulls, pa.scalar(None, lists.type), lists), pa.array(np.diff(offsets), mask=null), pc.if_else(nulls, pa.scalar(None, pa.bool_()), pc.equal(back, texts))]
                if with_text:
                    cols.append(pc.if_else(nulls, pa.scalar(None, pa.large_string()), back).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
