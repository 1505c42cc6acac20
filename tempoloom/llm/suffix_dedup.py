"""Repeated passages by a distributed difference-cover suffix sort.

Every occurrence but the first (by doc_id, then place) of a run of SPAN words or more is found, whatever surrounds it.

1. Equal texts are grouped; all but the least doc_id of a group are repeats as wholes and take no further part.
2. Any SPAN words hold the smallest of their GRAM-word hashes. Words that no window whose smallest hash recurs can cover
   can't be in a recurring passage and are left out, which changes no result; what is left are stretches of words.
3. The stretches' words get integer names, and their suffixes are sorted by the difference cover {1, 2} mod 3: sampled
   triples are sorted and named, the strings of names are sorted the same way, and the remaining suffixes are merged by
   (first name, rank of the rest). As only SPAN words are compared in the end, the recursion stops where a triple of
   names covers them; suffixes that agree so far are ties. The result is the order of prefixes, not a whole suffix array.
4. Adjacent suffixes are compared in their first SPAN words (by 64-bit hash, which only neighbours in this order can
   meet in); in each run the first by (doc_id, place) stays and the others are repeats.

Every step keeps one table of NumPy arrays for each partition in the shared checkpoint folder. Tasks send their distinct
keys, sorted and cut at sampled splitters, to the partition that ranks them, and get the ranks back, so a key that is
frequent costs one record a task. Messages of partition pairs travel together in batches of BATCH bytes, as there are as
many as the square of the partitions. Splitters are 20 keys a partition.

Defined results: rows with a null doc_id or text take no part; a text shorter than SPAN words has no repeats; repeated
rows (equal doc_id and text) count once; a doc_id with several texts counts as several documents; repeats within one
text count; case and punctuation don't (words are those of ``tokens``); ids may be of any type that has an order; other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempoloom.llm.common import checked_join, checkpoint, checkpoint_dir, partitions, text_slices
from tempoloom.llm.tokens import U, Words, mix, words

SPAN = 50
GRAM = 16
SAMPLES = 20
BATCH = 1 << 22  # bytes of messages that travel in one Arrow batch
Arrays = dict[str, np.ndarray]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; those that leave the row or the slice are to be ignored."""
    n, have, p = len(h), 0, 0x9E3779B97F4A7C15
    g, part, size = np.zeros(n, U), h.copy(), 1  # of the words so far, and of size words, a power of two
    while True:
        if k & size:  # the words so far come behind
            g[: max(n - size, 0)] = part[: max(n - size, 0)] * U(pow(p, have, 1 << 64)) + g[size:] if have else part[: max(n - size, 0)]
            if not have:
                g[max(n - size, 0) :] = part[max(n - size, 0) :]
            have += size
        if size * 2 > k:
            return mix(g)
        part[: max(n - size, 0)] = part[: max(n - size, 0)] * U(pow(p, size, 1 << 64)) + part[size:]
        size *= 2


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each window of so many elements; shorter by width - 1."""
    have, out = 1, x
    while have * 2 <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the places whose hash is the smallest of some window of SPAN words."""
    n, width = len(w.hash), SPAN - GRAM + 1
    if n < SPAN:
        return np.empty(0, np.int64), np.empty(0, U)
    g = grams(w.hash, GRAM)[: n - GRAM + 1]
    low = _slide(g, width, np.minimum)  # of the window that starts at each word
    low[w.row[: len(low)] != w.row[SPAN - 1 : SPAN - 1 + len(low)]] = 0
    pad = np.zeros(width - 1, U)
    high = _slide(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero((high == g) & (g != 0))
    return at, g[at]


def around(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretches of a text of so many words that windows with these anchors cover."""
    a = np.sort(at)
    first, end = np.maximum(a - (SPAN - GRAM), 0), np.minimum(a + SPAN, size)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return first[new], end[np.append(new[1:], len(a)) - 1]


# --- tables of arrays, one row for each partition, and messages between partitions


def _filesystem(base: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if base.startswith("file:"):
        base = "file://" + base[5:].replace("//", "", 1) if base.startswith("file://") else "file://" + base[5:]
    return pyarrow.fs.FileSystem.from_uri(base) if "://" in base else (pyarrow.fs.LocalFileSystem(), base)


def _parts(arrays: list[np.ndarray]) -> Iterator[bytes | np.ndarray]:
    """Each array behind 16 bytes of its type and length."""
    for a in arrays:
        yield a.dtype.str.encode().ljust(8) + len(a).to_bytes(8, "little")
        yield np.ascontiguousarray(a).view(np.uint8)


def _pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join(_parts(arrays))


def _unpack(data: bytes) -> list[np.ndarray]:
    """Arrays that share the memory of data."""
    at, out = 0, []
    while at < len(data):
        kind, n = np.dtype(data[at : at + 8].rstrip().decode()), int.from_bytes(data[at + 8 : at + 16], "little")
        out.append(np.frombuffer(data, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


class Store:
    """Tables of a file of arrays for each partition in the shared folder, which tasks write and read by themselves."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, partitions(spark)
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/suffixes-{uuid.uuid4().hex}"

    def clear(self, names: list[str] | None = None) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in [f"{self.base}/{x}" for x in names] if names else [self.base]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()  # lets Spark drop the shuffle files of finished steps

    def each(self) -> DataFrame:
        return self.spark.range(0, self.n, 1, self.n)


def save(base: str, name: str, part: int, arrays: list[np.ndarray]) -> None:
    """A file is written under a name of its own and then moved, so that a task that runs twice leaves one whole file."""
    fs, path = _filesystem(f"{base}/{name}")
    fs.create_dir(path)
    own = f"{path}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression="zstd") as out:
        for x in _parts(arrays):
            out.write(x)
    try:
        fs.move(own, f"{path}/{part}")
    except OSError:  # another run of the task was first
        if fs.get_file_info(f"{path}/{part}").type == pyarrow.fs.FileType.NotFound:
            raise
        fs.delete_file(own)


def load(base: str, name: str, part: int) -> list[np.ndarray]:
    fs, path = _filesystem(f"{base}/{name}/{part}")
    if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
        return []
    with fs.open_input_stream(path, compression="zstd") as src:
        return _unpack(src.read())


MESSAGE = "part int, frm int, data binary"


def _rows(parts: list[int], frm: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(frm, pa.int32()), pa.array(data, pa.binary())], names=["part", "frm", "data"])


def _batched(messages: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Messages (part, frm, data) in batches, as each pair of partitions may have one."""
    held, size = [], 0
    for x in messages:
        held.append(x)
        size += len(x[2])
        if size >= BATCH:
            yield _rows(*map(list, zip(*held)))
            held, size = [], 0
    if held:
        yield _rows(*map(list, zip(*held)))


def _saved(part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])


def _received(batches: Iterator[pa.RecordBatch]) -> dict[int, list[np.ndarray]]:
    got: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for f, d in zip(b.column(1).to_pylist(), b.column(2)):
            got[f] = _unpack(d.as_py())
    return got


def packed(fields: list[np.ndarray]) -> list[np.ndarray]:
    """Fields of the same order and equality, neighbours joined into 64 bits where they fit."""
    out: list[np.ndarray] = []
    room = 0
    for f in fields:
        bits = f.itemsize * 8 if f.dtype.kind == "u" else 64
        if out and bits <= room:
            out[-1] = (out[-1].astype(U) << U(bits)) | f.astype(U)
            room -= bits
        else:
            out.append(f)
            room = 64 - bits
    return out


def distinct(fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the distinct keys, sorted, and each row's place among them."""
    n, fields = len(fields[0]), packed(fields)
    order = np.lexsort(fields[::-1])
    new = np.zeros(n, bool)
    new[:1] = True
    for f in fields:
        s = f[order]
        new[1:] |= s[1:] != s[:-1]
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _cuts(fields: list[np.ndarray], splitters: list[tuple]) -> list[int]:
    """Where sorted keys are cut so that each piece lies between two splitters."""
    if not splitters:
        return []
    by = [np.array(x, U).astype(f.dtype) for f, x in zip(fields, zip(*splitters))]
    low, high = (np.searchsorted(fields[0], by[0], side) for side in ("left", "right"))
    for i in np.flatnonzero(low < high).tolist() if len(by) > 1 else ():
        a, b = int(low[i]), int(high[i])
        for f, x in zip(fields[1:], by[1:]):
            a, b = (a + int(np.searchsorted(f[a:b], x[i], side)) for side in ("left", "right"))
            if a == b:
                break
        low[i] = a
    return low.tolist()


def ranked(
    store: Store, name: str, keys: Callable[[int], tuple[list[np.ndarray], list[np.ndarray]]], rank: Callable[[list[np.ndarray], int], list[np.ndarray]], use: Callable[[int, np.ndarray, list[np.ndarray], list[np.ndarray]], list[np.ndarray]], by: int, unique: int
) -> None:
    """One step. keys(part) gives fields, of which the first ``by`` choose the partition that ranks a key and the first
    ``unique`` are what tells keys apart, and arrays that are kept for use(); rank(fields, part) gives the answers to a
    partition's keys; use(part, place, answers, kept) gives what is saved, place[i] being the answer to the part's i-th key.

    Keys are sorted once: the first job saves, for each partition, the distinct keys in order, the places, and a sample."""
    n, base = store.n, store.base

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (x for b in batches for x in b.column(0).to_pylist()):
            fields, kept = keys(p)
            m = len(fields[0]) if fields else 0
            place = np.empty(0, np.int64)
            if m:
                first, place = distinct(fields[:unique])
                fields, m = [f[first] for f in fields], len(first)
                place = place.astype(np.uint32) if m < 1 << 32 else place
            at = np.unique(np.linspace(0, m - 1, SAMPLES).astype(np.int64)) if m else np.empty(0, np.int64)
            save(base, f"{name}-keys", p, fields if m else [])
            save(base, f"{name}-places", p, [place, *kept])
            yield _rows([0], [p], [_pack([np.array([int(x) for x in f[at]], U) for f in fields[:by]] + [np.array([m])]) if m else b""])

    found = [_unpack(r[0]) for r in store.each().mapInArrow(sort, MESSAGE).select("data").collect() if r[0]]
    keyed = sorted((tuple(int(f[i]) for f in x[:by]), float(x[by][0]) / len(x[0])) for x in found for i in range(len(x[0])))
    splitters, total, so_far = [], sum(w for _, w in keyed), 0.0
    for key, w in keyed:
        if len(splitters) < n - 1 and so_far >= total * (len(splitters) + 1) / n and (not splitters or key > splitters[-1]):
            splitters.append(key)
        so_far += w
    shared = store.spark.sparkContext.broadcast(splitters)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for p in (x for b in batches for x in b.column(0).to_pylist()):
            fields = load(base, f"{name}-keys", p)
            if not fields:
                yield p, -1, b""
                continue
            cuts = [0, *_cuts(fields[:by], shared.value), len(fields[0])]
            for q, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    yield q, p, _pack([f[a:b] for f in fields])

    def answers_to(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        got = _received(batches)
        q = TaskContext.get().partitionId()
        got.pop(-1, None)
        if got:
            frm = sorted(got)
            fields = [np.concatenate([got[f][k] for f in frm]) for k in range(len(got[frm[0]]))]
            out, at = rank(fields, q), 0
            for f in frm:
                m = len(got[f][0])
                yield f, q, _pack([x[at : at + m] for x in out])
                at += m

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _received(batches)
        p = TaskContext.get().partitionId()
        place, *kept = load(base, f"{name}-places", p)
        answers = [np.concatenate([got[q][k] for q in sorted(got)]) for k in range(len(got[min(got)]))] if got else []
        save(base, name, p, use(p, place, answers, kept))
        yield _saved(p)

    sent = store.each().mapInArrow(lambda batches: _batched(pieces(batches)), MESSAGE).repartitionById(n, F.col("part"))
    back = sent.mapInArrow(lambda batches: _batched(answers_to(batches)), MESSAGE).repartitionById(n, F.col("part"))
    back.mapInArrow(receive, "part int").write.format("noop").mode("overwrite").save()
    del sent, back
    store.clear([f"{name}-keys", f"{name}-places"])


# --- strings of names


def inner(size: np.ndarray) -> np.ndarray:
    """Lengths of the strings of the places 1 mod 3, and of those 2 mod 3, of each string."""
    return np.stack([(size + 1) // 3, size // 3], 1).ravel()


def places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place in it, places from there to its end) of every place of the concatenated strings."""
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    return owner, at, size[owner] - at


def ahead(x: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The element k places on, or 0 beyond the string's end."""
    out = np.zeros(len(x), x.dtype)
    out[: len(x) - k] = x[k:]
    out[left <= k] = 0
    return out


def sampled(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places 1 and 2 mod 3, and where each of them is in the concatenated inner strings."""
    owner, at, _ = places(size)
    within = inner(size)
    start = np.cumsum(within) - within
    cover = np.flatnonzero(at % 3)
    return cover, start[2 * owner[cover] + at[cover] % 3 - 1] + at[cover] // 3


def levels() -> list[int]:
    """How many names must be compared at each depth: the last is at most 3."""
    need = [SPAN]
    while need[-1] > 3:
        need.append(-(-need[-1] // 3))
    return need


def triple_ranks(fields: list[np.ndarray]) -> np.ndarray:
    return distinct(fields)[1]


def merge_ranks(t0: np.ndarray, t1: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of suffixes of the three classes that start with names t0, t1.

    a, b: for class 0 the ranks of the suffixes one and two places on, else the own rank and that of the suffix one
    (class 1) or two (class 2) places on. Class 0 goes after the greatest of the others that is less.
    """
    _, group = distinct([t0, t1])
    zero = np.flatnonzero(c == 0)
    rest = np.flatnonzero(c != 0)
    _, s = distinct([group[rest], a[rest]])
    top = np.zeros(len(zero), np.int64)
    for k, rank in ((1, a[zero]), (2, b[zero])):
        own = np.flatnonzero(c[rest] == k)
        if not len(own) or not len(zero):
            continue
        r = b[rest[own]]
        _, dense = np.unique(np.concatenate([r, rank]), return_inverse=True)
        width = int(dense.max()) + 1
        x, z = group[rest[own]] * width + dense[: len(r)], group[zero] * width + dense[len(r) :]
        order = np.argsort(x, kind="stable")
        best = np.concatenate([[0], np.maximum.accumulate(s[own][order] + 1)])
        top = np.maximum(top, best[np.searchsorted(x[order], z, "left")])
    out = np.empty(len(t0), np.int64)
    if not len(zero):
        out[rest] = s
        return out
    first, place = distinct([top, group[zero], a[zero], b[zero]])
    before = top[first]
    out[zero] = np.arange(len(first))[place] + top
    out[rest] = s + np.searchsorted(before, s, "right")
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, keep_id, keep_first): words first..last of doc_id repeat those of keep_id from keep_first on."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        return _repeated_spans(docs.select("doc_id", "text"))
    # ids of other types are numbered in their order, which partitions of a range sort and then number by themselves
    ids = checkpoint(docs.select("doc_id").filter("doc_id is not null").distinct().orderBy("doc_id").select("doc_id", F.monotonically_increasing_id().alias("number")))
    numbered = checked_join(docs.select("doc_id", "text"), ids, ["doc_id"], "inner").select(F.col("number").alias("doc_id"), "text")
    found = _repeated_spans(numbered)
    for column in ("doc_id", "keep_id"):
        names = ids.select(F.col("number").alias(column), F.col("doc_id").alias("name"))
        found = checked_join(found, names, [column], "inner").withColumn(column, F.col("name")).drop("name")
    return found.select("doc_id", "first", "last", "keep_id", "keep_first")


def _repeated_spans(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    store = Store(spark)
    n, base = store.n, store.base
    own = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.col("text").cast("binary")).alias("md5"))
    own = own.withColumn("sub", F.conv(F.substring("md5", 1, 8), 16, 10).cast("long"))
    named = own.select("doc_id", "sub", "md5").distinct()
    least = named.groupBy("md5").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    copies = checkpoint(named.join(least.select("md5", "keep_id"), "md5").filter("doc_id <> keep_id").select("doc_id", "sub", "keep_id"))
    reps = checked_join(own.select("doc_id", "sub", "text"), copies.select("doc_id", "sub"), ["doc_id", "sub"], "left_anti")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                w = words(texts)
                at, h = anchors(w)
                begin = np.searchsorted(w.row, np.arange(rows.num_rows))
                r = pa.array(w.row[at])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), rows.column(0).take(r), rows.column(1).take(r), pa.array(at - begin[w.row[at]])], names=["h", "doc_id", "sub", "at"])

    found = reps.mapInArrow(anchored, "h long, doc_id long, sub long, at long").distinct()
    again = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    hits = found.join(again, "h").groupBy("doc_id", "sub").agg(F.collect_list("at").alias("at"))
    part = F.pmod(F.xxhash64("doc_id", "sub"), F.lit(n)).cast("int")
    both = hits.select(part.alias("part"), F.lit(0).alias("kind"), "doc_id", "sub", "at", F.lit(None).cast("string").alias("text"))
    both = both.union(reps.select(part.alias("part"), F.lit(1).alias("kind"), "doc_id", "sub", F.lit(None).cast("array<long>").alias("at"), "text"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit: dict[tuple[int, int], np.ndarray] = {}
        out: list[list[np.ndarray]] = [[], [], [], [], []]  # doc, sub, first word, words, hashes
        for batch in batches:
            kind = batch.column(1).to_numpy()
            for i in np.flatnonzero(kind == 0).tolist():
                hit[batch.column(2)[i].as_py(), batch.column(3)[i].as_py()] = batch.column(4)[i].values.to_numpy()
            keep = [i for i in np.flatnonzero(kind == 1).tolist() if (batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) in hit]
            for rows, texts in text_slices(batch.take(pa.array(keep, pa.int64())), "text"):
                w = words(texts)
                begin = np.searchsorted(w.row, np.arange(rows.num_rows + 1))
                for i in range(rows.num_rows):
                    key = rows.column(2)[i].as_py(), rows.column(3)[i].as_py()
                    if key not in hit:
                        continue
                    first, end = around(hit.pop(key), begin[i + 1] - begin[i])  # popped: repeated rows count once
                    out[0].append(np.full(len(first), key[0], np.int64))
                    out[1].append(np.full(len(first), key[1], np.uint32))
                    out[2].append(first)
                    out[3].append(end - first)
                    out[4] += [w.hash[begin[i] + a : begin[i] + b] for a, b in zip(first, end)]
        p = TaskContext.get().partitionId()
        kinds = (np.int64, np.uint32, np.int64, np.int64)
        *table, hashes = (*(np.concatenate([*x, np.empty(0, k)]).astype(k) for x, k in zip(out, kinds)), out[4])
        order = np.lexsort((table[2], table[1], table[0]))
        save(base, "stretches", p, [*(x[order] for x in table), np.concatenate([*(hashes[i] for i in order), np.empty(0, U)]).astype(U)])
        yield _saved(p)

    both.repartitionById(n, F.col("part")).sortWithinPartitions("kind").mapInArrow(stretches, "part int").write.format("noop").mode("overwrite").save()
    del found, again, hits, both
    store.clear(["none"])

    def strings(p: int) -> list[np.ndarray]:
        return load(base, "stretches", p) or [np.empty(0, k) for k in (np.int64, np.uint32, np.int64, np.int64, U)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (x for b in batches for x in b.column(0).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([len(strings(p)[4])])], names=["n"])

    total = store.each().mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    bits = total.bit_length() + 1
    kind = np.uint32 if bits + n.bit_length() <= 32 else np.uint64  # names are (partition, rank)
    name = lambda rank, q: ((q << bits) + rank + 1).astype(kind)
    need = levels() if total else [1]

    def size_at(k: int, p: int) -> np.ndarray:
        size = strings(p)[3]
        for _ in range(k):
            size = inner(size)
        return size

    def whole(p: int, place: np.ndarray, answers: list[np.ndarray], kept: list[np.ndarray]) -> list[np.ndarray]:
        return [answers[0][place] if answers else np.empty(0, kind)]

    if total:
        ranked(store, "x0", lambda p: ([strings(p)[4]], []), lambda f, q: [name(triple_ranks(f), q)], whole, 1, 1)

    def triples(k: int, p: int, every: bool) -> list[np.ndarray]:
        x, size = load(base, f"x{k}", p)[0], size_at(k, p)
        _, _, left = places(size)
        f = [x, ahead(x, left, 1), ahead(x, left, 2)]
        return f if every else [y[sampled(size)[0]] for y in f]

    for k in range(len(need) - 1):

        def to_inner(p: int, place: np.ndarray, answers: list[np.ndarray], kept: list[np.ndarray], k: int = k) -> list[np.ndarray]:
            _, to = sampled(size_at(k, p))
            out = np.zeros(len(to), kind)
            if answers:
                out[to] = answers[0][place]
            return [out]

        ranked(store, f"x{k + 1}", lambda p, k=k: (triples(k, p, False), []), lambda f, q: [name(triple_ranks(f), q)], to_inner, 2, 3)
    deep = len(need) - 1
    if total:
        ranked(store, f"r{deep}", lambda p: (triples(deep, p, True), []), lambda f, q: [name(triple_ranks(f), q)], whole, 2, 3)

    def classes(k: int, p: int) -> list[np.ndarray]:
        x, size, under = load(base, f"x{k}", p)[0], size_at(k, p), load(base, f"r{k + 1}", p)[0]
        _, at, left = places(size)
        cover, to = sampled(size)
        r = np.zeros(len(x), kind)
        r[cover] = under[to]
        c = (at % 3).astype(np.uint8)
        r1, r2 = ahead(r, left, 1), ahead(r, left, 2)
        return [x, ahead(x, left, 1), c, np.where(c == 0, r1, r), np.where(c == 1, r1, r2)]

    for k in range(deep - 1, 0, -1):
        ranked(store, f"r{k}", lambda p, k=k: (classes(k, p), []), lambda f, q: [name(merge_ranks(*f), q)], whole, 2, 5)
        store.clear([f"r{k + 1}", f"x{k + 1}"])

    def windows(p: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places from which SPAN words follow, with what tells them apart: hash of these words, document, place."""
        doc, sub, first, size, h = strings(p)
        owner, at, left = places(size)
        full = np.flatnonzero(left >= SPAN)
        return full, [grams(h, SPAN)[full], doc[owner[full]], sub[owner[full]], (first[owner[full]] + at[full]).astype(np.int64)]

    def last_keys(p: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        full, more = windows(p)
        fields = [f[full] for f in classes(0, p)] + more  # in order of documents and places, so that of equal keys the first comes first
        return fields, more[1:]

    def compare(f: list[np.ndarray], q: int) -> list[np.ndarray]:
        """The first occurrence of each key's SPAN words."""
        rank = merge_ranks(*f[:5])
        order = np.lexsort((f[8], f[7], f[6], f[5], rank))
        g = f[5][order]
        new = np.concatenate([[True], g[1:] != g[:-1]])  # adjacent suffixes that part within SPAN words
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(new) - 1
        by_run = np.lexsort((f[8], f[7], f[6], run))
        head = by_run[np.searchsorted(run[by_run], np.arange(int(new.sum())))]
        return [f[k][head][run] for k in (6, 7, 8)]

    def spans(p: int, place: np.ndarray, answers: list[np.ndarray], kept: list[np.ndarray]) -> list[np.ndarray]:
        if not answers:
            return [np.empty(0, np.int64)] * 5
        doc, sub, at = kept
        kd, ks, ka = (x[place] for x in answers)
        order = np.flatnonzero((doc != kd) | (sub != ks) | (at != ka))
        doc, sub, at, kd, ks, ka = (x[order] for x in (doc, sub, at, kd, ks, ka))
        same = lambda x, step: x[1:] == x[:-1] + x.dtype.type(step)
        start = np.flatnonzero(np.concatenate([[True], ~(same(doc, 0) & same(sub, 0) & same(at, 1) & same(kd, 0) & same(ks, 0) & same(ka, 1))])) if len(at) else np.empty(0, np.int64)
        end = np.append(start[1:], len(at))[: len(start)] - 1
        return [doc[start], at[start], at[end] + SPAN - 1, kd[start], ka[start]]

    if total:
        ranked(store, "spans", last_keys, compare, spans, 2, 6)
    schema = "doc_id long, first long, last long, keep_id long, keep_first long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (x for b in batches for x in b.column(0).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in load(base, "spans", p) or [np.empty(0)] * 5], names=["doc_id", "first", "last", "keep_id", "keep_first"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                size = np.bincount(words(texts).row, minlength=rows.num_rows)
                zero = np.zeros(rows.num_rows, np.int64)
                col = lambda c: rows.column(rows.schema.get_field_index(c))
                yield pa.RecordBatch.from_arrays([col("doc_id"), pa.array(zero), pa.array(size - 1), col("keep_id"), pa.array(zero)], names=["doc_id", "first", "last", "keep_id", "keep_first"]).filter(pa.array(size >= SPAN))

    given = checked_join(own.select("doc_id", "sub", "text").dropDuplicates(["doc_id", "sub"]), copies.select("doc_id", "sub"), ["doc_id", "sub"], "left_semi")
    given = given.join(copies.withColumnRenamed("doc_id", "_d").withColumnRenamed("sub", "_s"), (F.col("doc_id") == F.col("_d")) & (F.col("sub") == F.col("_s"))).select("doc_id", "keep_id", "text")
    out = checkpoint(store.each().mapInArrow(read, schema).union(given.mapInArrow(counted, schema)))
    store.clear()
    return out


#: The same by all windows of SPAN words.
SQL = f"""
WITH copies AS (SELECT doc_id, keep_id, text FROM (SELECT DISTINCT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) WHERE doc_id <> keep_id),
reps AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND (doc_id, text) NOT IN (SELECT (doc_id, text) FROM copies)),
wins AS (SELECT doc_id, text, i, md5(array_to_string(w[i + 1 : i + {SPAN}], ' ')) AS k FROM (SELECT *, unnest(range(0, len(w) - {SPAN} + 1)) AS i FROM reps)),
firsts AS (SELECT *, first_value(doc_id) OVER o AS kd, first_value(text) OVER o AS kt, first_value(i) OVER o AS ki FROM wins WINDOW o AS (PARTITION BY k ORDER BY doc_id, md5(text), i)),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, text, kd, kt, ki - i ORDER BY i) AS island FROM firsts WHERE (doc_id, text, i) <> (kd, kt, ki))
SELECT doc_id, min(i) AS first, max(i) + {SPAN - 1} AS last, kd AS keep_id, min(ki) AS keep_first FROM marked GROUP BY doc_id, text, kd, kt, ki - i, island
UNION ALL SELECT doc_id, 0, len(w) - 1, keep_id, 0 FROM (SELECT *, regexp_extract_all(lower(text), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM copies) WHERE len(w) >= {SPAN}"""
