"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoloom.functions.textfn import clean, sentences, token_count

MAX, OVERLAP, MIN = 500, 50, 100
PACKED = "array<struct<chunk_index:int,content:string,token_count:int>>"


def char_windows(docs: DataFrame, max_tokens: int = MAX, overlap: int = OVERLAP, min_tokens: int = 0) -> DataFrame:
    """Windows of 4 * max_tokens characters that overlap by 4 * overlap and end with the text; no Python."""
    size, step = max_tokens * 4, (max_tokens - overlap) * 4
    n = F.greatest(F.lit(1), F.ceil((F.length("content") - size) / step) + 1).cast("int")
    at = docs.select("doc_id", clean(F.col("text")).alias("content")).filter("content <> ''").select("doc_id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    cut = at.withColumn("content", F.substring(F.col("content"), F.col("chunk_index") * step + 1, F.lit(size)))
    return _finished(cut.withColumn("token_count", token_count(F.col("content"))), min_tokens)


def token_windows(docs: DataFrame, max_tokens: int = MAX, overlap: int = OVERLAP, min_tokens: int = 0, tokens: Callable[[Column], Column] = lambda c: F.split(c, " "), join: str = " ") -> DataFrame:
    """Windows of max_tokens tokens that overlap and end with the text; words by default."""
    step = max_tokens - overlap
    parts = docs.select("doc_id", clean(F.col("text")).alias("c")).filter("c <> ''").select("doc_id", tokens(F.col("c")).alias("t"))
    n = F.greatest(F.lit(1), F.ceil((F.size("t") - max_tokens) / step) + 1).cast("int")
    at = parts.select("doc_id", "t", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    piece = F.slice("t", F.col("chunk_index") * step + 1, F.lit(max_tokens))
    return _finished(at.select("doc_id", "chunk_index", F.array_join(piece, join).alias("content"), F.size(piece).alias("token_count")), min_tokens)


def pack(parts: list[str], count: Callable[[str], int], max_tokens: int = MAX, overlap: int = OVERLAP) -> list[tuple[int, str, int]]:
    """Sentences packed in order; each new chunk begins with the last sentences that fit in the overlap."""
    out: list[tuple[int, str, int]] = []
    held: list[str] = []
    size = 0
    for part in parts:
        n = count(part)
        if not held or size + n <= max_tokens:
            held.append(part)
            size += n
            continue
        out.append((len(out), " ".join(held), size))
        room, first = overlap, len(held)
        while first and count(held[first - 1]) <= room:
            first -= 1
            room -= count(held[first])
        held = [*held[first:], part]
        size = count(" ".join(held))
    if held:
        text = " ".join(held)
        out.append((len(out), text, count(text)))
    return out


def sentence_chunks(docs: DataFrame, max_tokens: int = MAX, overlap: int = OVERLAP, min_tokens: int = MIN, count: Callable[[str], int] = lambda s: len(s) // 4) -> DataFrame:
    """A text of max_tokens at most is one chunk; others are packed by sentences, and chunks below min_tokens dropped."""

    @F.pandas_udf(PACKED)
    def packed(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: [dict(zip(("chunk_index", "content", "token_count"), x)) for x in pack(list(p), count, max_tokens, overlap)])

    own = docs.select("doc_id", clean(F.col("text")).alias("c")).filter("c <> ''").withColumn("n", token_count(F.col("c")))
    short = own.filter(F.col("n") <= max_tokens).select("doc_id", F.lit(0).alias("chunk_index"), F.col("c").alias("content"), F.col("n").alias("token_count"))
    long = own.filter(F.col("n") > max_tokens).select("doc_id", F.inline(packed(sentences(F.col("c"))))).filter(F.col("token_count") >= min_tokens)
    return _finished(short.unionByName(long), 0)


def _finished(chunks: DataFrame, min_tokens: int) -> DataFrame:
    kept = chunks.filter(F.col("token_count") >= min_tokens) if min_tokens else chunks
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return kept.select(name.alias("chunk_id"), "doc_id", "chunk_index", "content", "token_count")


def stats(chunks: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    t = F.col("token_count")
    return chunks.agg(F.count("*").alias("chunks"), zero(F.sum(t)).alias("tokens"), F.coalesce(F.avg(t), F.lit(0.0)).alias("mean_tokens"), zero(F.min(t)).alias("min_tokens"), zero(F.max(t)).alias("max_tokens"))
