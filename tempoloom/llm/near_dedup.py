"""Near-duplicate search by BagMinHash over multisets of word shingles, banding, and exact multiset overlap.

A shingle of weight w has a Poisson process of rate one for each signature register over (0, w] x time. The weight axis
is discretised into unit cells under a hierarchy: (0, 1], (1, 2], (2, 4], (4, 8] ... are the roots, and each halves down
to its cells. A process gives its first point and is then split: the half that the point falls to keeps it and is split
on, the other half goes on from that time as a process of its own, and halves beyond w are left out at once. What
reaches a cell is a point of a register. All documents with the shingle make the same points, and a process stops as
soon as its time passes the largest register of its document. A register keeps its earliest point, and two documents
agree in a register with the probability of their weighted Jaccard similarity.

Signatures are cut into BANDS bands. Documents of equal bags count as one. Of each bucket, each document is first
compared with the least id among its buckets. Then, as long as a bucket has members of more than one component, its
components' least members are compared with the least of them (first round), and up to PIVOTS of its members with all
members of other components (later rounds); a pivot that was compared with all leaves the bucket. Before the later rounds
buckets of more than WIDE members, mostly documents that share a passage and little else, are cut by prefix filtering:
members stay together only where they share one of their rarest tokens, as all similar ones do. Pairs that are in one
component already can't change the groups, so the groups are those of all bucket pairs, with no cap, and no round emits
more than PIVOTS rows for a member. Buckets and ids that a large share of all rows meet in are salted.

Defined results: a document without words, with a null text or with a null doc_id has no bag and is never a duplicate;
one shorter than SHINGLE words has one shingle of them all; ties of similarity with the threshold count as duplicates;
the least doc_id of a group stays (ids may be of any type that has an order); of repeated rows with one doc_id all stay
or all go. Other columns pass untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoloom.llm.common import BROADCAST_ROWS, HEAVY_ROWS, checked_join, checkpoint, components, heavy_keys, merged_components, salted_join, sieve, sized_join, text_slices
from tempoloom.llm.tokens import U, mix, shingles, words

SHINGLE = 3
BANDS, ROWS = 40, 3
REGISTERS = BANDS * ROWS
THRESHOLD = 0.4
PIVOTS = 128
#: Beyond so many members, a bucket that is still open after the first round is cut by the words that similar documents must share.
WIDE = 16
CELLS = 1 << 18


def bags(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of a large-string array, sorted by row and shingle."""
    row, h = shingles(words(texts), k)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if not len(h):
        return row, h, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m) earliest times; infinite for rows without shingles."""
    sig = np.full(n * m, np.inf)
    level = np.ceil(np.log2(weight)).astype(np.int64) + 1  # roots of a shingle of this weight
    at = np.repeat(np.arange(len(row)), level)
    k = np.arange(len(at)) - np.repeat(np.cumsum(level) - level, level)
    lo = np.where(k == 0, 0.0, 2.0 ** (k - 1))
    ln = np.where(k == 0, 1.0, lo)
    r, w, s = row[at], weight[at], mix(shingle[at] + k.astype(U) * U(0xD6E8FEB86659FD93))

    def drawn(s: np.ndarray, r: np.ndarray, w: np.ndarray, lo: np.ndarray, ln: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        """The processes with the times of their next points."""
        s = mix(s + U(0x9E3779B97F4A7C15))
        return [s, r, w, lo, ln, t - np.log(_uniform(s)) / (m * ln)]

    live, later = drawn(s, r, w, lo, ln, np.zeros(len(at))), []
    total = np.maximum(np.bincount(row, weight, n), 1)
    until = (np.log(m) + 0.5) / total  # points are made window by window, so that most rows' registers are full after the first
    while True:
        late = live[5] > until[live[1]]
        later.append([x[late] for x in live])
        s, r, w, lo, ln, t = (x[~late] for x in live)
        if not len(s):
            largest = sig.reshape(n, m).max(1)
            live, later = [np.concatenate(x) for x in zip(*later)], []
            on = live[5] <= largest[live[1]]
            live = [x[on] for x in live]
            if not len(live[0]):
                return sig.reshape(n, m)
            until += 1 / total
            continue
        h, waiting = mix(s ^ U(0xA0761D6478BD642F)), []
        while len(wide := np.flatnonzero(ln > 1)):
            half, right = ln[wide] / 2, (h[wide] >> U(63)).astype(float)
            other = lo[wide] + (1 - right) * half
            there = other < w[wide]
            i = wide[there]
            waiting.append((mix(h[i] ^ U(0x8EBC6AF09C88C6E3)), r[i], w[i], other[there], half[there], t[i]))
            lo[wide] += right * half
            ln[wide] = half
            h[wide] = mix(h[wide] + U(0x589965CC75374CC3))
        within = lo < w
        if not within.all():
            h, s, r, w, lo, ln, t = (x[within] for x in (h, s, r, w, lo, ln, t))
        np.minimum.at(sig, r * m + (mix(h + U(1)) % U(m)).astype(np.int64), t)
        live = drawn(*(np.concatenate(x) for x in zip((s, r, w, lo, ln, t), *waiting)) if waiting else (s, r, w, lo, ln, t))


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(n, bands) int64; the band's number is part of the hash."""
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x2545F4914F6CDD1D), bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        h = mix(h * U(3) + bits[:, :, j])
    return h.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            n = rows.num_rows
            row, h, w = bags(texts)
            there = np.bincount(row, minlength=n) > 0
            hashes = band_hashes(signatures(row, h, w, n))
            ends = np.searchsorted(row, np.arange(n + 1))
            ids = []
            for seed in (U(0x8CB92BA72F3D8DD7), U(0xE7037ED1A0B428DB)):  # 128 bits name the bag
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(mix(h ^ seed) + w.astype(U)), dtype=U)])
                ids.append(mix(sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(hashes.ravel()))
            out = pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(ids[0]), pa.array(ids[1]), lists], names=["doc_id", "b1", "b2", "bands"])
            yield out.filter(pa.array(there))


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            row, h, w = bags(texts)
            row, h = np.repeat(row, w), np.repeat(h, w)
            ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
            data = [h[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(data, pa.binary())], names=["doc_id", "bag"])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    both = np.concatenate([a, b])
    names, at = np.unique(both, return_inverse=True)
    ca, cb = np.bincount(at[: len(a)], minlength=len(names)), np.bincount(at[len(a) :], minlength=len(names))
    return np.minimum(ca, cb).sum() / max(1, np.maximum(ca, cb).sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("bag_a", "bag_b"))
        ok = [overlap(np.frombuffer(a[i].as_py(), U), np.frombuffer(b[i].as_py(), U)) >= THRESHOLD for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def bags_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, bag) of the documents with these ids, checkpointed."""
    own = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    bag = checkpoint(checked_join(own, ids, ["doc_id"], "left_semi").mapInArrow(_bagged, f"doc_id {kind}, bag binary").filter("length(bag) > 0"))
    return bag if bag.count() == ids.count() else checkpoint(bag.distinct())  # repeated rows


def verify(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b and checkpointed, whose multisets overlap enough; both ends may be hubs. Few pairs shuffle only their own bags."""
    n = pairs.count()
    hubs = {c: heavy_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), [c]) if n > HEAVY_ROWS else None for c in ("a", "b")}
    if n <= BROADCAST_ROWS // 2:
        bags = checkpoint(bags.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "doc_id", "left_semi"))
    kind = pairs.schema["a"].dataType.simpleString()
    with_b = salted_join(pairs, bags.toDF("b", "bag_b"), ["b"], ["a"], hubs["b"])
    both = salted_join(with_b, bags.toDF("a", "bag_a"), ["a"], ["b"], hubs["a"])
    return checkpoint(both.select("a", "b", "bag_a", "bag_b").mapInArrow(_verified, f"a {kind}, b {kind}").distinct())


def _in_buckets(member: DataFrame, buckets: DataFrame, longs: int = 1) -> DataFrame:
    """Members with what is known of their buckets: (bucket, n) and so many longs."""
    most = BROADCAST_ROWS // longs
    if buckets.limit(most + 1).count() <= most:
        return checkpoint(member.join(F.broadcast(buckets.drop("n")), "bucket"))
    return checkpoint(salted_join(sieve(member, buckets, ["bucket"]), buckets.drop("n"), ["bucket"], ["doc_id"], heavy_keys(buckets, ["bucket"])))


def _tokens(bag: np.ndarray) -> np.ndarray:
    """A sorted multiset as a set: the i-th copy of a shingle is a token of its own."""
    first = np.concatenate([[True], bag[1:] != bag[:-1]])
    at = np.arange(len(bag))
    return mix(bag + (at - at[first][np.cumsum(first) - 1]).astype(U) * U(0x9E3779B97F4A7C15))


def prefix(tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The tokens of which two sets share one if their Jaccard similarity reaches THRESHOLD: all but the last of an order,
    here of the (estimated) number of documents that have them, rarest first. Any order that all sets follow is right."""
    order = np.lexsort((tokens, count[(tokens & U(len(count) - 1)).astype(np.int64)]))
    return tokens[order[: len(tokens) - int(np.ceil(THRESHOLD * len(tokens) - 1e-9)) + 1]]


def narrowed(member: DataFrame, comp: DataFrame, bags: DataFrame) -> DataFrame:
    """(doc_id, bucket) with the same similar pairs in common buckets: members of a bucket of more than WIDE meet only where they share a token of their prefixes."""
    kind = bags.schema["doc_id"].dataType.simpleString()
    hot = checkpoint(member.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > WIDE))
    if not hot.limit(1).count():
        return member
    wide = checkpoint(sized_join(member, hot, ["bucket"], ["doc_id"]))
    own = checkpoint(checked_join(bags, checkpoint(wide.select("doc_id").distinct()), ["doc_id"], "left_semi"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount((_tokens(np.frombuffer(x.as_py(), U)) & U(CELLS - 1)).astype(np.int64), minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    got = own.select("bag").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    count = np.zeros(CELLS, np.int64)
    count[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    shared = bags.sparkSession.sparkContext.broadcast(count)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            found = [prefix(_tokens(np.frombuffer(x.as_py(), U)), shared.value).view(np.int64) for x in batch.column(batch.schema.get_field_index("bag"))]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([ids.take(row), pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], names=["doc_id", "token"])

    token = own.mapInArrow(first, f"doc_id {kind}, token long").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "token", F.coalesce("comp", "doc_id").alias("comp"))
    again = token.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low <> high").select("token", "n")
    token = checkpoint(sized_join(token.select("doc_id", "token"), checkpoint(again), ["token"], ["doc_id"]))
    cut = wide.join(token, "doc_id").select("doc_id", F.xxhash64("bucket", "token").alias("bucket"))
    return checked_join(member, hot.select("bucket"), ["bucket"], "left_anti").select("doc_id", "bucket").unionByName(cut)


def groups(docs: DataFrame) -> DataFrame:
    """(id, comp) for every document that is in a group of near duplicates; comp is the group's least doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    signed = checkpoint(key.mapInArrow(_signed, f"doc_id {kind}, b1 long, b2 long, bands array<long>"))
    same = checkpoint(signed.groupBy("b1", "b2").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    equal = salted_join(signed.select("doc_id", "b1", "b2"), same.drop("n"), ["b1", "b2"], ["doc_id"], heavy_keys(same, ["b1", "b2"]))
    equal = checkpoint(equal.filter("doc_id <> a").distinct())
    reps = checked_join(signed, equal.select("doc_id", "b1", "b2"), ["doc_id", "b1", "b2"], "left_anti")
    member = reps.select("doc_id", F.explode("bands").alias("bucket"))
    hot = member.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low <> high").drop("high")
    member = _in_buckets(member, checkpoint(hot))
    bags = bags_of(docs, checkpoint(member.select("doc_id").distinct()))
    star = checkpoint(member.groupBy("doc_id").agg(F.min("low").alias("a")).filter("a <> doc_id").select("a", F.col("doc_id").alias("b")))
    comp, tried, member, turn = components(verify(star, bags)), star, member.select("doc_id", "bucket"), 0
    while True:
        if turn == 1:
            member = narrowed(member, comp, bags)
        placed = checkpoint(member.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "bucket", F.coalesce("comp", "doc_id").alias("comp")))
        slot = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(PIVOTS)) if turn else F.lit(0)
        slots = placed.groupBy("bucket", slot.alias("slot")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.min(F.struct("doc_id", "comp")).alias("p"))
        mixed = slots.groupBy("bucket").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.collect_list("p").alias("pivots")).filter("low <> high")  # PIVOTS at most
        mixed = checkpoint(mixed.select("bucket", "n", "pivots"))
        if not mixed.limit(1).count():
            break
        open_ = _in_buckets(placed, mixed, 2 * PIVOTS if turn else 2)
        asked = open_ if turn else _in_buckets(open_.groupBy("bucket", "comp").agg(F.min("doc_id").alias("doc_id")), mixed, 2)
        more = asked.select("doc_id", "comp", F.explode("pivots").alias("p")).filter("p.comp <> comp")
        more = more.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct()
        more = checkpoint(more.join(tried, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            new, tried = verify(more, bags), checkpoint(tried.union(more))
            if new.limit(1).count():
                comp = merged_components(comp, new)
        left = open_.filter(~F.array_contains(F.transform("pivots", lambda p: p["doc_id"]), F.col("doc_id"))) if turn else open_
        member, turn = checkpoint(left.select("doc_id", "bucket")), turn + 1
    return components(comp.filter("id <> comp").select(F.col("comp").alias("a"), F.col("id").alias("b")).union(equal.select("a", F.col("doc_id").alias("b"))))


def near_copies(docs: DataFrame) -> DataFrame:
    """(keep_id, doc_id): each document that goes, with the one of its group that stays."""
    return groups(docs).filter("id <> comp").select(F.col("comp").alias("keep_id"), F.col("id").alias("doc_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs of which no lesser doc_id is a near duplicate, all columns kept."""
    gone = checkpoint(near_copies(docs).select("doc_id").distinct())
    return checked_join(docs, gone, ["doc_id"], "left_anti")
