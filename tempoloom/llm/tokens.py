"""Vectorised words of text batches: lower-cased UTF-8 bytes, word bounds and 64-bit word hashes, without Python loops.

A word is a maximal run of ASCII letters, digits and non-ASCII characters after lower-casing; byte positions are those
of the text as given, since a character whose lower case has another length in UTF-8 stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_TAB = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_P, _POW = 0x9E3779B97F4A7C15 | 1, {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n + 1:
        size = max(n + 1, 1 << 19)
        for k, base in (("p", _P), ("q", pow(_P, -1, 2**64))):
            a = np.full(size, base, U)
            a[0] = 1
            _POW[k] = np.cumprod(a, dtype=U)
    return _POW["p"], _POW["q"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large-string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def lower(texts: pa.Array) -> pa.Array:
    low = pc.utf8_lower(texts)
    odd = np.flatnonzero(pc.not_equal(pc.binary_length(low), pc.binary_length(texts)).to_numpy(zero_copy_only=False))
    if len(odd):
        rows = low.to_pylist()
        for i in odd.tolist():
            rows[i] = "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in texts[i].as_py())
        low = pa.array(rows, pa.large_string())
    return low


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes of all rows
    offsets: np.ndarray  # of the rows in data
    start: np.ndarray  # of the words in data
    end: np.ndarray
    row: np.ndarray  # of the words
    hash: np.ndarray


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross rows."""
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    full = np.flatnonzero(np.diff(offsets))
    first, last = offsets[full], offsets[full + 1] - 1
    begin[first] = mask[first]
    end[last] = mask[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a polynomial."""
    p, q = _powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_TAB[data] * p[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(U))


def words(texts: pa.Array) -> Words:
    data, offsets = buffers(lower(texts))
    start, end = runs(_WORD[data], offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, row, span_hash(data, start, end))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k words; a row of fewer words has one shingle of them all."""
    n = len(w.hash)
    if not n:
        return np.empty(0, np.int64), np.empty(0, U)
    h = np.zeros(n, U)
    for j in range(min(k, n)):
        h[: n - j] = mix(h[: n - j] + w.hash[j:] * U(2 * j + 3))
    count = np.bincount(w.row, minlength=len(w.offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = np.arange(n) - first[w.row]
    whole = at + k <= count[w.row]
    rows, hashes = w.row[whole], h[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        total = np.zeros(n + 1, U)
        np.cumsum(w.hash * (at.astype(U) * U(2) + U(3)), out=total[1:])
        extra = mix(total[first[short] + count[short]] - total[first[short]])
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, extra])
    return rows, hashes
