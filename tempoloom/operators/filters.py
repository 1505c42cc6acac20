"""Filters of nodes and edges, by time among others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoloom.functions.timefn import expand
from tempoloom.operators.graph import TEMPORAL


def nodes_in(nodes: DataFrame, months: list[str], mode: str = "strict") -> DataFrame:
    """Nodes of the months (their neighbours too if expanded); those without a month go."""
    return nodes.filter(F.col("date").isin(expand(months, "adjacent") if mode == "expanded" else list(months)))


def edge_in(months: list[str], scope: str = "cross_time") -> Column:
    """Semantic edges by month; temporal ones always (all, cross_time) or by month (within_range)."""
    dated = F.coalesce(F.col("date").isin(list(months)), F.lit(False))
    return F.when(F.col("is_temporal"), F.lit(True) if scope in ("all", "cross_time") else dated).otherwise(dated)


def edges_in(edges: DataFrame, months: list[str], mode: str = "strict", scope: str = "cross_time") -> DataFrame:
    return edges.filter(edge_in(expand(months, "adjacent") if mode == "expanded" else list(months), scope))


def neighbor_in(date: Column, has_temporal: Column, months: list[str], mode: str, scope: str) -> Column:
    """Whether a neighbour may be reached: by its month, or with_temporal also over a temporal edge if the scope allows."""
    inside = F.coalesce(date.isin(expand(months, "adjacent") if mode == "expanded" else list(months)), F.lit(False))
    return inside | (has_temporal & F.lit(scope in ("all", "cross_time"))) if mode == "with_temporal" else inside


def semantic_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.coalesce(F.array_contains("relation_keywords", TEMPORAL), F.lit(False)))


def equal_to(wanted: dict[str, object] | None) -> Column:
    """Every named column has the value; a null never does."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(k) == F.lit(v), F.lit(False)) for k, v in (wanted or {}).items()), F.lit(True))
