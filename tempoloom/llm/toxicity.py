"""Toxic documents by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are a seed lexicon of insults, lexicons of words and word beginnings mined from labelled documents, densities of
these, and patterns of direct address, masked swearing and shouting. The votes of all documents are counted by pattern.
A latent-class model is fitted to these counts by expectation maximisation: first with independent voters, whose
accuracies it estimates; then correlations given the class are measured, voters correlated beyond LINK are joined into
blocks of at most BLOCK voters, and the model is fitted again with one joint distribution for each block. The linear
classifier learns hashed words, word beginnings and votes from the posteriors and scores every document.

Samples are bounded by documented parameters: MINE_TOXIC and MINE_CLEAN labelled documents for the lexicons (near copies
counted once), TRAIN_TOXIC and TRAIN_CLEAN documents for the classifier, each by hash order. Votes, their counts and
scores cover every document.

Defined results: null and empty texts get no vote for toxicity and score as such; labels without a document, with nulls
or contradicting each other are dropped; without labels only the seed lexicon and patterns vote; repeated rows are judged
one by one; ties with the threshold are toxic; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoloom.llm.common import checkpoint, hash_sample, text_slices
from tempoloom.llm.linear import fit, scores, sigmoid
from tempoloom.llm.near_dedup import bags, band_hashes, signatures
from tempoloom.llm.tokens import U, Words, mix, span_hash, words

SEED = """arschloch asshole bastard bitch cabron clown connard conne crap cretin cretino disgusting douchebag dumb dumbass
estupido filth freak garbage gilipollas hure hurensohn idiot idiota idiote idioten imbecil imbecile imbécile imbécil inutile
jerk kretin loser losers merde mierda moron morons pathetic pendejo puta putain retard salaud salope scheisse scheiße
schlampe schwachkopf scum shit slut stupid stupide subnormal trash trottel vermin whore wichser worthless wretch estúpido
cabrón crétin dégueulasse imbéciles idiotas""".split()
ADDRESS = r"(?i)\b(?:you(?:'re| are)|du bist|ihr seid|tu es|vous êtes|eres|sois) (?:an? |such an? |so |ein |eine |un |une )?\pL+"
MASKED = r"\pL[*#@$%]{2,}\pL"
VOTERS = ("seed", "seed_twice", "seed_dense", "word", "words_3", "begin4", "begin4_3", "begin5", "begin5_3", "address", "masked", "shout")
MINE_TOXIC, MINE_CLEAN = 3000, 6000
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
LIFT, LEAST = 25.0, 4
LINK, BLOCK = 0.25, 4
DIM = 1 << 16
THRESHOLD = 0.5


@dataclass
class Lexicons:
    """Sorted hashes of words and of word beginnings of four and five bytes."""

    seed: np.ndarray
    word: np.ndarray
    begin4: np.ndarray
    begin5: np.ndarray


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def begins(w: Words, n: int) -> np.ndarray:
    """Hash of each word's first n bytes, 0 for words that aren't longer."""
    return np.where(w.end - w.start > n, span_hash(w.data, w.start, np.minimum(w.start + n, w.end)), U(0))


def large(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.large_string())


def distinct_near(texts: list[str]) -> np.ndarray:
    """Rows of which no earlier row shares a band of its signature."""
    seen: set[int] = set()
    keep = []
    for i in range(0, len(texts), 200):
        part = texts[i : i + 200]
        row, h, n = bags(large(part))
        there = np.bincount(row, minlength=len(part)) > 0
        for k, x in enumerate(band_hashes(signatures(row, h, n, len(part))).tolist()):
            if there[k] and seen.isdisjoint(x):
                seen.update(x)
                keep.append(i + k)
    return np.array(keep, np.int64)


def mine(toxic: list[str], clean: list[str]) -> Lexicons:
    """Words and beginnings found in LEAST toxic texts at least, LIFT times as often as in clean ones."""
    texts, y = toxic + clean, np.repeat([True, False], [len(toxic), len(clean)])
    keep = distinct_near(texts)
    texts, y = [texts[i] for i in keep], y[keep]
    found: list[list[np.ndarray]] = [[[], []] for _ in range(3)]  # type: ignore[misc]
    for i in range(0, len(texts), 200):
        w = words(large(texts[i : i + 200]))
        for k, h in enumerate((w.hash, begins(w, 4), begins(w, 5))):
            pairs = np.unique(np.stack([w.row.astype(U), h]), axis=1)
            pairs = pairs[:, pairs[1] != 0]
            for c in (0, 1):
                found[k][c].append(pairs[1][y[i + pairs[0].astype(np.int64)] == bool(c)])
    out = []
    for clean_, toxic_ in found:
        t, nt = np.unique(np.concatenate([*toxic_, np.empty(0, U)]), return_counts=True)
        c, nc = np.unique(np.concatenate([*clean_, np.empty(0, U)]), return_counts=True)
        also = np.zeros(len(t))
        both = _in(c, t)
        also[both] = nc[np.searchsorted(c, t[both])]
        lift = ((nt + 0.5) / (y.sum() + 1)) / ((also + 0.5) / ((~y).sum() + 1))
        out.append(t[(nt >= LEAST) & (lift >= LIFT)])
    seed = np.unique(words(large([" ".join(SEED)])).hash)
    return Lexicons(seed, *out)


def votes(lex: Lexicons, texts: pa.Array, w: Words) -> np.ndarray:
    """(n, voters) of bools."""
    n = len(texts)
    count = lambda hit: np.bincount(w.row[hit], minlength=n)
    total = np.bincount(w.row, minlength=n)
    seed, word = count(_in(lex.seed, w.hash)), count(_in(lex.word, w.hash))
    b4, b5 = count(_in(lex.begin4, begins(w, 4))), count(_in(lex.begin5, begins(w, 5)))
    regex = lambda p: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False)
    upper = pc.utf8_length(pc.replace_substring_regex(texts, r"[^\p{Lu}]+", "")).to_numpy(zero_copy_only=False)
    shout = (upper > 0.5 * pc.utf8_length(texts).to_numpy(zero_copy_only=False)) & regex("!")
    return np.stack([seed > 0, seed > 1, seed * 100 > total, word > 0, word > 2, b4 > 0, b4 > 2, b5 > 0, b5 > 2, regex(ADDRESS), regex(MASKED), shout], 1)


@dataclass
class LabelModel:
    blocks: list[list[int]]
    table: list[np.ndarray]  # of each block: (2, 2 ** voters) probabilities given the class
    prior: float
    accuracy: np.ndarray
    correlation: np.ndarray  # given the class

    def posterior(self, v: np.ndarray) -> np.ndarray:
        x = np.log(self.prior) - np.log(1 - self.prior) + np.zeros(len(v))
        for b, t in zip(self.blocks, self.table):
            at = v[:, b] @ (1 << np.arange(len(b)))
            x += np.log(t[1][at]) - np.log(t[0][at])
        return sigmoid(x)


def label_model(v: np.ndarray, count: np.ndarray, rounds: int = 60) -> LabelModel:
    """Fit to vote patterns v (patterns, voters) and how many documents have each."""
    v, count = v.astype(np.int64), count.astype(float)
    k, total = v.shape[1], max(count.sum(), 1)

    def run(blocks: list[list[int]], p: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray]:
        for _ in range(rounds):
            prior = float(np.clip((p * count).sum() / total, 1e-4, 0.5))
            table = []
            for b in blocks:
                at = v[:, b] @ (1 << np.arange(len(b)))
                t = np.stack([np.bincount(at, count * q, 2 ** len(b)) for q in (1 - p, p)]) + 0.1
                table.append(t / t.sum(1, keepdims=True))
            p = LabelModel(blocks, table, prior, np.empty(0), np.empty(0)).posterior(v)
        return table, prior, p

    p = np.where(v[:, [0, 3, 5, 7]].sum(1) >= 1, 0.9, 0.02)  # lexicon hits start as likely toxic
    blocks = [[j] for j in range(k)]
    _, _, p = run(blocks, p)
    cor = np.zeros((k, k))
    for q in (p, 1 - p):
        m = count * q
        s = max(m.sum(), 1e-9)
        d = v - (v * m[:, None]).sum(0) / s
        c = (d * m[:, None]).T @ d / s
        sd = np.sqrt(np.maximum(np.diag(c), 1e-6))
        cor += 0.5 * c / np.outer(sd, sd)
    for i, j in sorted(((i, j) for i in range(k) for j in range(i)), key=lambda x: -abs(cor[x])):
        a, b = (next(x for x in blocks if y in x) for y in (i, j))
        if abs(cor[i, j]) > LINK and a is not b and len(a) + len(b) <= BLOCK:
            blocks = [x for x in blocks if x is not a and x is not b] + [sorted(a + b)]
    table, prior, p = run(blocks, p)
    right = np.where(v == 1, p[:, None], 1 - p[:, None])
    return LabelModel(blocks, table, prior, (right * count[:, None]).sum(0) / total, cor)


def features(texts: pa.Array, w: Words, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value): words and beginnings by hash, votes last; a text's distinct hashes share a norm."""
    h = np.concatenate([w.hash, begins(w, 4) * U(3), begins(w, 5) * U(5)])
    at = (mix(h + U(1)) % U(DIM)).astype(np.int64)
    row = np.tile(w.row, 3)[h != 0]
    pairs = np.unique(row * DIM + at[h != 0])
    row, at = pairs // DIM, pairs % DIM
    n = np.bincount(row, minlength=len(texts))
    r, j = np.nonzero(v)
    return np.concatenate([row, r]), np.concatenate([at, DIM + j]), np.concatenate([1 / np.sqrt(n[row]), np.ones(len(r))])


def _bits(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (1 << np.arange(v.shape[1]))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, posterior, voters) of the toxic documents: the classifier's probability, the label model's, and who voted."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("_wsl_toxic")).filter("low = _wsl_toxic").drop("low")
    size = {r[0]: r[1] for r in known.groupBy("_wsl_toxic").count().collect()}
    picked = hash_sample(known.filter("_wsl_toxic = 1"), MINE_TOXIC, size.get(1, 0)).union(hash_sample(known.filter("_wsl_toxic = 0"), MINE_CLEAN, size.get(0, 0)))
    picked = checkpoint(picked)
    rows = own.filter("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "_wsl_toxic").collect()  # at most MINE_TOXIC + MINE_CLEAN ids
    rows.sort()  # here, as a sort in Spark would sample texts for its ranges
    lex = mine([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    del rows
    shared = spark.sparkContext.broadcast(lex)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                v = votes(shared.value, texts, words(texts))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_bits(v))], names=["doc_id", "pattern"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cast = checkpoint(own.mapInArrow(vote, f"doc_id {kind}, pattern long"))
    counts = cast.groupBy("pattern").count().orderBy("pattern").collect()  # at most 2 ** len(VOTERS) rows
    pattern = np.array([r[0] for r in counts], np.int64)
    v = (pattern[:, None] >> np.arange(len(VOTERS))) & 1
    model = label_model(v, np.array([r[1] for r in counts]))
    post = dict(zip(pattern.tolist(), model.posterior(v).tolist()))
    likely = [k for k, p in post.items() if p >= 0.5]
    n = sum(r[1] for r in counts if r[0] in set(likely))
    total = sum(r[1] for r in counts)
    one, other = cast.filter(F.col("pattern").isin(likely)), cast.filter(~F.col("pattern").isin(likely))
    chosen = checkpoint(hash_sample(one, TRAIN_TOXIC, n).union(hash_sample(other, TRAIN_CLEAN, total - n)).select("doc_id").distinct())
    rows = own.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text").collect()
    rows.sort()
    parts = []
    for i in range(0, len(rows), 500):
        texts = large([r[1] for r in rows[i : i + 500]])
        w = words(texts)
        x = votes(lex, texts, w)
        r, f, val = features(texts, w, x)
        parts.append(((r + i).astype(np.int32), f.astype(np.int32), val.astype(np.float32), model.posterior(x.astype(np.int64))))
    del rows
    if parts:
        r, f, val, y = (np.concatenate(x) for x in zip(*parts))
        del parts
        weight = fit(r, f, val, y, DIM + len(VOTERS))
    else:
        weight = np.append(np.zeros(DIM + len(VOTERS)), -30.0)
    final = spark.sparkContext.broadcast((lex, weight.astype(np.float32), model))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, weight, model = final.value
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                w = words(texts)
                x = votes(lex, texts, w)
                p = sigmoid(scores(weight, *features(texts, w, x), rows.num_rows))
                bad = np.flatnonzero(p >= threshold)
                who = pa.array([[VOTERS[j] for j in np.flatnonzero(x[i])] for i in bad], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(bad)), pa.array(np.round(p[bad].astype(float), 6)), pa.array(np.round(model.posterior(x[bad].astype(np.int64)), 6)), who], names=["doc_id", "toxicity", "posterior", "voters"])

    return own.mapInArrow(judge, f"doc_id {kind}, toxicity double, posterior double, voters array<string>")
