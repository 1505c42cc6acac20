"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items and texts are read as lower-cased words. The automaton accepts every run of words of every item; streaming a
text's words through it gives, at each word, the length of the longest match that ends there. A match is removed if it
has MIN_WORDS words or more, or at least SHORT_WORDS and COVERAGE of the shortest item that contains it. A document is
dropped if DROP_SHARE or more of its words are removed; else the bytes from the first to the last word of each span go.

Only stretches whose every run of SHORT_WORDS - 2 words starts with three words that some item also has in that order
can hold a match of SHORT_WORDS; the others are passed over without changing any result.

The automaton is built on the driver and broadcast. Test sets don't grow with the corpus, but their size is checked:
beyond SHARD_WORDS the items are cut into several automata, which are run one after the other, LINKS to a Spark stage.

Defined results: null and empty items match nothing; an item of fewer than SHORT_WORDS words matches nothing, as its
words may stand in any text; a null or empty text is clean; overlapping spans are merged; repeated rows are cleaned one
by one. Other columns pass untouched whatever their names, save an integer n_chars of a text that was cut, which gets
its new length. An empty benchmark or table gives no spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempoloom.llm.common import checkpoint, free, text_slices
from tempoloom.llm.tokens import U, Words, mix, words

MIN_WORDS = 13
SHORT_WORDS = 5
COVERAGE = 0.8
DROP_SHARE = 0.5
SHARD_WORDS = 1_000_000
LINKS = 4


@dataclass
class Automaton:
    """State 0 is the root. Transitions are sorted by state * len(vocabulary) + word."""

    vocabulary: np.ndarray  # sorted word hashes
    key: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    item: np.ndarray  # words of the shortest item that contains the state's runs
    shorter: np.ndarray  # longest proper suffix, of a state on the way to the root, that is to be removed by itself
    grams: np.ndarray  # sorted hashes of the items' word triples


def triples(h: np.ndarray) -> np.ndarray:
    return mix(mix(h[:-2] + U(1)) ^ mix(h[1:-1] + U(2)) * U(3) ^ mix(h[2:] + U(3)) * U(5))


def _bad(m, item):
    """Whether a run of m words of an item of so many is to be removed."""
    return (m >= MIN_WORDS) | ((m >= SHORT_WORDS) & (m >= COVERAGE * item))


def build(items: list[np.ndarray]) -> Automaton:
    """items: word hashes of each."""
    vocabulary = np.unique(np.concatenate([*items, np.empty(0, U)]))
    step: list[dict[int, int]] = [{}]
    link, length, item = [-1], [0], [1 << 60]

    def add(last: int, c: int) -> int:
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else split(last, c, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        item.append(1 << 60)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
        return new

    def split(p: int, c: int, q: int) -> int:
        clone = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        item.append(item[q])
        link[q] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    for words_ in items:
        last = 0
        for c in np.searchsorted(vocabulary, words_).tolist():
            last = add(last, c)
    for words_ in items:  # every prefix's state and its suffix links
        s = 0
        for c in np.searchsorted(vocabulary, words_).tolist():
            s = step[s][c]
            item[s] = min(item[s], len(words_))
    for s in sorted(range(1, len(step)), key=lambda s: -length[s]):
        item[link[s]] = min(item[link[s]], item[s])
    shorter = [0] * len(step)
    for s in sorted(range(1, len(step)), key=lambda s: length[s]):
        a = link[s]
        shorter[s] = length[a] if a and _bad(length[a], item[a]) else shorter[a]
    rows = [(s * len(vocabulary) + c, t) for s, x in enumerate(step) for c, t in x.items()]
    key, to = np.array(sorted(rows), np.int64).reshape(-1, 2).T
    grams = np.unique(np.concatenate([*(triples(x) for x in items if len(x) > 2), np.empty(0, U)]))
    return Automaton(vocabulary, np.ascontiguousarray(key), np.ascontiguousarray(to), np.array(link), np.array(length), np.array(item), np.array(shorter), grams)


def found(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x would stand in the sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def stretches(a: Automaton, w: Words, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run whose word triples all occur in an item, of SHORT_WORDS words at least."""
    n = len(w.hash)
    if n < SHORT_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g = triples(w.hash)
    hot = np.zeros(n + 1, bool)
    near = np.flatnonzero(bits[(g & U(len(bits) - 1)).astype(np.int64)] & (w.row[:-2] == w.row[2:]))
    hot[near[found(a.grams, g[near])[1]]] = True
    edge = np.diff(np.concatenate([[0], hot.view(np.int8)]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # the last triple has two more words
    long = last - first + 1 >= SHORT_WORDS
    return first[long], last[long]


def matches(a: Automaton, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, longest match that ends there and is to be removed, or 0) for each word of the stretches."""
    order = np.argsort(first - last, kind="stable")
    first, size = first[order], (last - first + 1)[order]
    state, length = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    v, out = len(a.vocabulary), []
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        c, there = found(a.vocabulary, h[first[:n] + j])
        s, m = state[:n], length[:n]
        s[~there], m[~there] = 0, 0
        todo = np.flatnonzero(there)
        while len(todo):
            at, ok = found(a.key, s[todo] * v + c[todo])
            done = todo[ok]
            s[done] = a.to[at[ok]]
            m[done] += 1
            todo = todo[~ok]
            todo_root = s[todo] == 0
            m[todo[todo_root]] = 0
            todo = todo[~todo_root]
            s[todo] = a.link[s[todo]]
            m[todo] = a.length[s[todo]]
        out.append((first[:n] + j, np.where(_bad(m, a.item[s]), m, a.shorter[s])))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2  # type: ignore[return-value]


def spans(a: Automaton, w: Words, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, longest match) of the merged spans to remove, in order."""
    at, m = matches(a, w.hash, *stretches(a, w, bits))
    bad = m > 0
    return merged(at[bad] - m[bad] + 1, at[bad], m[bad])


def merged(first: np.ndarray, last: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(first, kind="stable")
    first, last, m = first[order], last[order], m[order]
    if not len(first):
        return first, last, m
    reach = np.maximum.accumulate(last)
    start = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return first[start], np.maximum.reduceat(last, start), np.maximum.reduceat(m, start)


def bitmap(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(max(1 << 16, 1 << int(np.ceil(np.log2(16 * len(grams) + 1)))), bool)
    bits[(grams & U(len(bits) - 1)).astype(np.int64)] = True
    return bits


def automata(benchmark: DataFrame) -> list[Automaton]:
    rows = benchmark.filter("text is not null").select("text").distinct().toArrow()
    w = words(rows.column(0).cast(pa.large_string()).combine_chunks()) if rows.num_rows else None
    items = [x for x in np.split(w.hash, np.searchsorted(w.row, np.arange(1, rows.num_rows)))] if w is not None else []
    items, shards, n = [x for x in items if len(x) >= SHORT_WORDS], [[]], 0
    for x in items:
        if n + len(x) > SHARD_WORDS and shards[-1]:
            shards.append([])
            n = 0
        shards[-1].append(x)
        n += len(x)
    return [build(s) for s in shards if s]


class Names:
    """Columns that are added, under names that docs doesn't have."""

    def __init__(self, docs: DataFrame):
        self.spans, self.text, self.words, self.gone = (free(f"_gsa_{x}", docs) for x in ("spans", "text", "words", "gone"))

    def cut(self, out: DataFrame) -> T.StructType:
        return T.StructType([*out.schema.fields, T.StructField(self.text, T.StringType()), T.StructField(self.words, T.LongType()), T.StructField(self.gone, T.LongType())])


def marked(docs: DataFrame, benchmark: DataFrame, names: Names) -> DataFrame:
    """docs with spans: int64 triples (first word, last word, longest match), null where the text is clean."""
    schema, column = T.StructType([*docs.schema.fields, T.StructField(names.spans, T.BinaryType())]), names.spans
    out = docs.withColumn(column, F.lit(None).cast("binary"))
    for k, a in enumerate(automata(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast((a, bitmap(a.grams)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a, bits = shared.value
            for batch in batches:
                for rows, texts in text_slices(batch, "text"):
                    w = words(texts)
                    first, last, m = spans(a, w, bits)
                    if len(first):
                        at, row = rows.schema.get_field_index(column), w.row[first]
                        begin = np.searchsorted(w.row, np.arange(rows.num_rows))
                        old = rows.column(at).to_pylist()
                        for i in np.unique(row).tolist():
                            s = row == i
                            x = np.stack([first[s] - begin[i], last[s] - begin[i], m[s]])
                            if old[i]:
                                x = np.stack(merged(*np.concatenate([x, np.frombuffer(old[i], np.int64).reshape(3, -1)], 1)))
                            old[i] = x.astype(np.int64).tobytes()
                        rows = rows.set_column(at, rows.schema.field(at), pa.array(old, rows.schema.field(at).type))
                    yield rows

        if k and k % LINKS == 0:
            out = checkpoint(out)
        out = out.mapInArrow(run, schema)
    return out


def _cut(batches: Iterator[pa.RecordBatch], names: Names) -> Iterator[pa.RecordBatch]:
    """Adds the cut text, the words of the text, and those that went."""
    for batch in batches:
        for rows, texts in text_slices(batch, "text"):
            marks = rows.column(rows.schema.get_field_index(names.spans)).to_pylist()
            w = words(texts)
            begin = np.searchsorted(w.row, np.arange(rows.num_rows + 1))
            clean, gone = [], []
            for i, x in enumerate(marks):
                first, last, _ = np.frombuffer(x, np.int64).reshape(3, -1)
                raw, at, pieces = texts[i].as_py().encode(), 0, []
                for a, b in zip(w.start[begin[i] + first] - w.offsets[i], w.end[begin[i] + last] - w.offsets[i]):
                    pieces.append(raw[at:a])
                    at = b
                clean.append(b"".join([*pieces, raw[at:]]).decode())
                gone.append(int((last - first + 1).sum()))
            n = np.diff(begin)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(clean, pa.string()), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64())], names=[*rows.schema.names, names.text, names.words, names.gone])


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [np.frombuffer(x, np.int64).reshape(3, -1) for x in batch.column(batch.schema.get_field_index("_gsa_spans")).to_pylist()]
        lists = pa.array([",".join(f"{a}-{b}" for a, b in zip(x[0], x[1])) for x in marks], pa.string())
        longest = pa.array([int(x[2].max()) for x in marks], pa.int64())
        col = lambda c: batch.column(batch.schema.get_field_index(c))
        yield pa.RecordBatch.from_arrays([col("doc_id"), longest, lists, col("_gsa_words"), col("_gsa_gone"), col("_gsa_text")], names=["doc_id", "longest", "spans", "words", "removed", "clean_text"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document with spans: longest match, spans (first-last word, by commas), words, removed words, dropped, clean_text."""
    own = docs.select("doc_id", "text")
    names = Names(own)
    out = marked(own, benchmark, names)
    hit = out.filter(F.col(names.spans).isNotNull()).mapInArrow(lambda batches: _cut(batches, names), names.cut(out))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = hit.mapInArrow(_findings, f"doc_id {kind}, longest long, spans string, words long, removed long, clean_text string")
    return out.withColumn("dropped", F.col("removed") >= DROP_SHARE * F.col("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the spans cut out and the documents that are mostly test items dropped, same columns, in one pass."""
    names = Names(docs)
    out = marked(docs, benchmark, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(np.array(batch.column(batch.schema.get_field_index(names.spans)).is_valid()), pa.bool_())
            clean = batch.filter(pa.compute.invert(hit))
            if clean.num_rows:
                n = clean.num_rows
                text = clean.column(clean.schema.get_field_index("text"))
                yield pa.RecordBatch.from_arrays([*clean.columns, text, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=[*clean.schema.names, names.text, names.words, names.gone])
            yield from _cut(iter([batch.filter(hit)]), names)

    done = out.mapInArrow(run, names.cut(out)).filter(F.coalesce(F.col(names.gone) < DROP_SHARE * F.col(names.words), F.lit(True)))
    length = dict(docs.dtypes).get("n_chars")
    if length in ("int", "bigint"):
        done = done.withColumn("n_chars", F.when(F.col(names.spans).isNotNull(), F.length(names.text).cast(length)).otherwise(F.col("n_chars")))
    return done.withColumn("text", F.col(names.text)).select(*[F.col(f"`{c}`") for c in docs.columns])


_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
_WORDS = f"regexp_extract_all(lower(text), '{_WORD}+')"
#: An item's runs of k words mark words, k being the least number that is removed; the marks are those of all its longer runs.
SQL = f"""
WITH items AS (SELECT DISTINCT w, least({MIN_WORDS}, greatest({SHORT_WORDS}, ceil(len(w) * 0.8 - 1e-9)))::BIGINT AS k FROM (SELECT {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) >= {SHORT_WORDS}),
item_grams AS (SELECT row_number() OVER () AS item, k, w FROM items),
grams AS (SELECT item, k, p, array_to_string(w[p + 1 : p + k], ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS p FROM item_grams)),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
hits AS (SELECT r, i, p, item, x.k FROM (SELECT r, k, i, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM items))) x JOIN grams g ON g.k = x.k AND g.gram = x.gram),
islands AS (SELECT r, item, k, i, p, i - row_number() OVER (PARTITION BY r, item, i - p ORDER BY i) AS island FROM hits),
runs AS (SELECT r, min(i) AS first, max(i) + k - 1 AS last FROM islands GROUP BY r, item, k, i - p, island),
ordered AS (SELECT *, max(last) OVER (PARTITION BY r ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR first > before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS span FROM ordered),
spans AS (SELECT r, span, min(first) AS first, max(last) AS last, max(last - first + 1) AS longest FROM numbered GROUP BY r, span),
found AS (SELECT r, max(longest) AS longest, string_agg(first || '-' || last, ',' ORDER BY first) AS spans, sum(last - first + 1)::BIGINT AS removed FROM spans GROUP BY r),
pieces AS (SELECT r, regexp_extract_all(text, '(?s)[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*{_WORD}+') AS ps, regexp_extract(text, '(?s)[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*$') AS tail FROM docs WHERE r IN (SELECT r FROM found)),
piece AS (SELECT r, tail, i, ps[i + 1] AS t FROM (SELECT *, unnest(range(0, len(ps))) AS i FROM pieces)),
cut AS (SELECT piece.r, tail, i, CASE WHEN s.r IS NULL THEN t WHEN i = first THEN regexp_replace(t, '{_WORD}+$', '') ELSE '' END AS t FROM piece LEFT JOIN spans s ON s.r = piece.r AND i BETWEEN first AND last),
clean AS (SELECT r, string_agg(t, '' ORDER BY i) || any_value(tail) AS clean_text FROM cut GROUP BY r)
SELECT doc_id, longest, spans, len(w)::BIGINT AS words, removed, clean_text, removed >= {DROP_SHARE} * len(w) AS dropped FROM found JOIN docs USING (r) JOIN clean USING (r)"""
