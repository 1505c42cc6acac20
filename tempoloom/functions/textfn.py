"""Text functions. A token is four characters unless a tokenizer is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"(?<=[.!?])\s+(?=[A-Z])"


def token_count(c: Column) -> Column:
    return F.coalesce(F.floor(F.length(c) / 4), F.lit(0)).cast("int")


def clean(c: Column) -> Column:
    """White space, Unicode's included, becomes single spaces; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE), lambda s: F.trim(s)), lambda s: s != "")


def truncate_tokens(c: Column, tokens: Column | int) -> Column:
    n = F.lit(tokens) if isinstance(tokens, int) else tokens
    return F.when(token_count(c) > n, F.concat(F.substring(c, F.lit(1), (n * 4).cast("int")), F.lit("..."))).otherwise(c)


def preview(c: Column, chars: int) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


def document_of(chunk_id: Column) -> Column:
    return F.substring_index(chunk_id, "_chunk_", 1)


def match_share(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords that occur in the text, whatever their case; 0 without keywords."""
    if not keywords:
        return F.lit(0.0)
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return F.coalesce(hits / F.lit(float(len(keywords))), F.lit(0.0))
