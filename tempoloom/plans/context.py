"""Context lines within token budgets, and the prompt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoloom.functions.textfn import document_of, preview, token_count, truncate_tokens
from tempoloom.operators.ranking import numbered, within_budget
from tempoloom.plans.params import QueryParams

EMPTY = "No context data available"


@dataclass(frozen=True)
class Budgets:
    available: int
    entity: int
    relation: int
    chunk: int


def budgets(base_tokens: int, p: QueryParams) -> Budgets:
    """30 % each for entities and relations within their limits, the rest for chunks."""
    left = max(0, p.final_max_tokens - base_tokens)
    entity, relation = (min(m, int(0.3 * left)) for m in (p.entity_max_tokens, p.relation_max_tokens))
    return Budgets(left, entity, relation, left - entity - relation)


def _dated(head, description):
    date = F.nullif(F.col("date"), F.lit(""))
    return F.concat(head, F.when(date.isNotNull(), F.concat(F.lit(" ["), date, F.lit("]"))).otherwise(F.lit("")), F.lit(": "), description)


def entity_lines(entities: DataFrame, budget: int, cut: int = 200, *ties: str) -> DataFrame:
    d = truncate_tokens(F.coalesce("description", F.lit("No description")), cut)
    head = F.concat(F.lit("- **"), F.coalesce("name", F.lit("Unknown")), F.lit("** ("), F.coalesce("type", F.lit("Unknown")), F.lit(")"))
    lines = entities.withColumn("line", _dated(head, d)).withColumn("tokens", token_count(F.col("line")))
    return within_budget(lines, budget, "tokens", [F.desc("score"), *(ties or ("node_id",))])


def relation_lines(relations: DataFrame, budget: int, cut: int = 150, *ties: str) -> DataFrame:
    """relations with source and target names."""
    d = truncate_tokens(F.coalesce("description", F.lit("No description")), cut)
    head = F.concat(F.lit("- **"), F.coalesce("source", F.lit("Unknown")), F.lit("** "), F.coalesce("type", F.lit("related to")), F.lit(" **"), F.coalesce("target", F.lit("Unknown")), F.lit("**"))
    lines = relations.withColumn("line", _dated(head, d)).withColumn("tokens", token_count(F.col("line")))
    return within_budget(lines, budget, "tokens", [F.desc("score"), *(ties or ("src", "dst", "type"))])


def chunk_lines(chunks: DataFrame, budget: int, most: int = 800, order: tuple = ("chunk_id",)) -> DataFrame:
    """Each chunk gets an equal part of the budget, ``most`` tokens at most."""
    size = chunks.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    cap = F.least(F.lit(most), F.floor(F.lit(budget) / F.col("_n"))).cast("int")
    named = numbered(chunks, list(order)).crossJoin(F.broadcast(size)).withColumn("line", F.concat(F.lit("**Chunk "), F.col("number").cast("string"), F.lit(":** "), truncate_tokens(F.col("content"), cap)))
    return within_budget(named.withColumn("tokens", token_count(F.col("line"))), budget, "tokens", ["number"]).drop("_n")


def chunk_previews(chunks: DataFrame, chars: int = 500) -> DataFrame:
    return chunks.withColumn("line", F.concat(F.lit("**"), document_of(F.col("chunk_id")), F.lit(":** "), preview(F.col("content"), chars)))


def section(lines: DataFrame, order: str, join: str = "\n") -> DataFrame:
    """One row: the lines in order, and their tokens."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("line"))))
    return lines.agg(F.array_join(F.transform(got, lambda x: x["line"]), join).alias("text"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("lines"))


def joined(entities: str, relations: str, chunks: str) -> str:
    parts = [f"### {name}\n{text}" for name, text in (("Entities", entities), ("Relationships", relations), ("Document Chunks", chunks)) if text]
    return "\n\n".join(parts) or EMPTY


def time_line(months: list[str]) -> str:
    return f"Analysis limited to time period: {', '.join(months)}" if months else ""


def estimate(entities: DataFrame, relations: DataFrame, chunks: DataFrame, base_tokens: int = 0) -> DataFrame:
    """Tokens of the sections if nothing is cut: entities, relations, chunks, total. relations have source and target names."""
    none = 1 << 60
    parts = [entity_lines(entities, none, none), relation_lines(relations, none, none), chunks.withColumn("tokens", token_count(F.col("content")))]
    a, b, c = (p.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias(n)) for p, n in zip(parts, ("entities", "relations", "chunks")))
    return a.crossJoin(b).crossJoin(c).withColumn("total", F.col("entities") + F.col("relations") + F.col("chunks") + base_tokens)
