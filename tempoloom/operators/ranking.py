"""Top k, keep-first, beams and budgets. Every ranking ends with a tiebreaker, since tables have no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, k: int, score: str = "score", *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), *ties).limit(k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def beam(candidates: DataFrame, frontier: DataFrame, width: int, score: str = "score", *ties: str) -> DataFrame:
    """The best width rows for each row of the frontier, all together."""
    ranked = candidates.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), *ties)))
    size = frontier.agg((F.count("*") * width).alias("_most"))
    return ranked.crossJoin(F.broadcast(size)).filter("_rn <= _most").drop("_rn", "_most")


def within_budget(lines: DataFrame, budget: int, tokens: str, order: list[Column | str]) -> DataFrame:
    """Lines in order until one would exceed the budget: as tokens aren't negative, those whose running sum fits."""
    total = F.sum(tokens).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("running", total).filter(F.col("running") <= budget)


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
