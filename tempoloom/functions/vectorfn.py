"""Vector functions over arrays, summed in double precision."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, null where a vector is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer for cosine; lower for the distances."""
    kinds = {"cosine": cosine, "cosine_distance": lambda x, y: 1 - cosine(x, y), "l2": l2, "squared_l2": squared_l2}
    if metric not in kinds:
        raise ValueError(f"no such metric: {metric}")
    return kinds[metric](a, b)


def hashed(text: str, dim: int = 64) -> list[float]:
    """Offline embedding: words hashed to signed places, of unit length; zeros for a text without words."""
    v = [0.0] * dim
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embedder(encode=hashed):
    """A pandas UDF text -> array<double> of a function text -> vector (any sequence)."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [float(x) for x in encode(t)])

    return embed


def dimension(encode=hashed, default: int = 384) -> int:
    """Length of the vectors that an encoder gives; the default where it gives none."""
    try:
        return len(encode("test")) or default
    except Exception:  # noqa: BLE001 - an encoder that isn't there has no dimension of its own
        return default
