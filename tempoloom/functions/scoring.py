"""Scores of entities, relations and neighbours. Every function takes and gives columns; null times count as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempoloom.functions.timefn import index_of, month_index

SEMANTIC, TEMPORAL = 0.6, 0.4


def mix(s: Column, t: Column, semantic: float = SEMANTIC, temporal: float = TEMPORAL) -> Column:
    total = semantic + temporal
    return s if total == 0 else (F.lit(semantic) * s + F.lit(temporal) * t) / F.lit(total)


def relevance(date: Column, months: list[str]) -> Column:
    """1 for one of the months, else the greatest similarity to one of them; 0 for what is no month."""
    known = [i for i in map(index_of, months) if i is not None]
    if not known:
        return F.lit(0.0)
    i = month_index(date)
    near = F.array_max(F.transform(F.array(*[F.lit(k) for k in known]), lambda k: F.greatest(F.lit(0.0), 1 - F.abs(k - i) / F.lit(5.0))))
    return F.coalesce(F.when(date.isin(months), F.lit(1.0)), near, F.lit(0.0))


def connected_entity(relation: Column, t: Column | None, semantic: float = SEMANTIC, temporal: float = TEMPORAL) -> Column:
    return F.lit(0.8) * mix(F.coalesce(relation, F.lit(0.5)), F.lit(1.0) if t is None else t, semantic, temporal)


def neighbour(cos: Column, t: Column | None, centrality: Column, hop: int, temporal_edge: Column, semantic: float = SEMANTIC, temporal: float = TEMPORAL) -> Column:
    base = F.lit(0.6) * mix(F.coalesce(cos, F.lit(0.3)), F.lit(1.0) if t is None else t, semantic, temporal) + F.lit(0.3) * F.coalesce(centrality, F.lit(0.0)) + F.lit(0.2 * 0.4)
    return F.least(F.lit(1.0), base * F.lit(0.8**hop) * F.when(temporal_edge, F.lit(1.2)).otherwise(F.lit(1.0)))


def edge_semantic(to_source: Column, to_target: Column, description: Column) -> Column:
    """Mean of the similarities that there are; 0.3 without any, 0.2 without a description."""
    n = to_source.isNotNull().cast("int") + to_target.isNotNull().cast("int")
    mean = (F.coalesce(to_source, F.lit(0.0)) + F.coalesce(to_target, F.lit(0.0))) / F.nullif(n, F.lit(0))
    return F.when(F.coalesce(F.trim(description), F.lit("")) == "", F.lit(0.2)).otherwise(F.coalesce(mean, F.lit(0.3)))


def edge(sem: Column, t: Column | None, centrality: Column, hop: int, semantic: float = SEMANTIC, temporal: float = TEMPORAL) -> Column:
    base = F.lit(0.7) * mix(sem, F.lit(1.0) if t is None else t, semantic, temporal) + F.lit(0.4) * F.coalesce(centrality, F.lit(0.0)) + F.lit(0.5 * 0.3)
    return F.least(F.lit(1.0), base * F.lit(0.7**hop))
