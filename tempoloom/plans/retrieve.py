"""Retrieval as one plan over the tables nodes, edges, node centrality and edge centrality.

Entities and relations carry ``src_ord``, where they come from: 0 found directly, 1 connected to a relation, 2 and up by
hop. The first source wins when results meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoloom.functions import scoring as S
from tempoloom.functions import vectorfn as V
from tempoloom.functions.textfn import match_share
from tempoloom.operators.filters import edge_in, neighbor_in, semantic_edges
from tempoloom.operators.ranking import beam, keep_first
from tempoloom.plans.params import QueryParams

ENTITY = ("node_id", "name", "type", "description", "date", "chunk_id", "first_ord", "embedding")
RELATION = ("src", "dst", "type", "description", "date", "chunk_id", "first_ord", "is_temporal")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    node_centrality: DataFrame
    edge_centrality: DataFrame


def _mixed(s, p: QueryParams):
    return S.mix(s, S.relevance(F.col("date"), p.months), p.semantic_weight, p.temporal_weight) if p.months else s


def _time(p: QueryParams):
    return S.relevance(F.col("date"), p.months) if p.months else None


def _entities(df: DataFrame) -> DataFrame:
    return df.select(*ENTITY, "score", "semantic", "src_ord", "place")


def entity_search(nodes: DataFrame, query: Sequence[float], p: QueryParams, over_fetch: int | None = 3) -> DataFrame:
    """The nearest over_fetch * top_k entities (all of them if None), scored again with time, above the threshold, top k."""
    own = nodes.filter("node_type = 'entity' and embedding is not null").withColumn("semantic", F.round(V.cosine(F.col("embedding"), V.literal(query)), 12))
    if over_fetch:
        own = own.orderBy(F.desc("semantic"), "first_ord", "node_id").limit(over_fetch * p.top_k)
    return _top_entities(own.withColumn("score", _mixed(F.col("semantic"), p)).filter(F.col("score") >= p.similarity_threshold), p)


def entity_text_search(nodes: DataFrame, keywords: list[str], p: QueryParams) -> DataFrame:
    """Share of the keywords in name and description; with a time range, time alone may do."""
    text = F.concat_ws(" ", "name", "description")
    own = nodes.filter("node_type = 'entity'").withColumn("semantic", match_share(text, keywords))
    return _top_entities(own.withColumn("score", _mixed(F.col("semantic"), p)).filter("score > 0"), p)


def _top_entities(scored: DataFrame, p: QueryParams) -> DataFrame:
    ranked = scored.orderBy(F.desc("score"), "first_ord", "node_id").limit(p.top_k)
    if "embedding" not in ranked.columns:
        ranked = ranked.withColumn("embedding", F.lit(None).cast("array<double>"))
    return _entities(ranked.withColumn("src_ord", F.lit(0)).withColumn("place", F.row_number().over(_order(F.desc("score"), "first_ord", "node_id"))))


def _order(*cols):
    from pyspark.sql.window import Window

    return Window.orderBy(*cols)


def _relation(df: DataFrame) -> DataFrame:
    kind = F.when(F.size("relation_keywords") > 0, F.array_join("relation_keywords", ", ")).otherwise(F.lit("unknown"))
    return df.withColumn("type", kind)


def relation_search(edges: DataFrame, query: Sequence[float], p: QueryParams) -> DataFrame:
    own = semantic_edges(edges).filter("embedding is not null").withColumn("semantic", F.round(V.cosine(F.col("embedding"), V.literal(query)), 12))
    return _top_relations(own.withColumn("score", _mixed(F.col("semantic"), p)).filter(F.col("score") >= p.similarity_threshold), p)


def relation_text_search(edges: DataFrame, keywords: list[str], p: QueryParams) -> DataFrame:
    text = F.concat_ws(" ", F.array_join("relation_keywords", " "), "description")
    own = semantic_edges(edges).withColumn("semantic", match_share(text, keywords))
    return _top_relations(own.withColumn("score", _mixed(F.col("semantic"), p)).filter("score > 0"), p)


def _top_relations(scored: DataFrame, p: QueryParams) -> DataFrame:
    order = (F.desc("score"), F.col("first_ord"), F.col("src"), F.col("dst"))
    top = _relation(scored).orderBy(*order).limit(p.top_k)
    return top.withColumn("place", F.row_number().over(_order(*order))).withColumn("src_ord", F.lit(0)).select(*RELATION, "score", "semantic", "src_ord", "place")


def connected_entities(relations: DataFrame, nodes: DataFrame, p: QueryParams) -> DataFrame:
    """Endpoints of relations, each by its first relation, source before target."""
    ends = relations.select("place", F.col("score").alias("relation_score"), F.posexplode(F.array("src", "dst")).alias("side", "node_id"))
    first = keep_first(ends, ["node_id"], ["place", "side"])
    got = first.select("node_id", "relation_score", (F.col("place") * 2 + F.col("side")).alias("place")).join(nodes, "node_id").withColumn("semantic", F.lit(None).cast("double"))
    if "embedding" not in got.columns:
        got = got.withColumn("embedding", F.lit(None).cast("array<double>"))
    return _entities(got.withColumn("score", S.connected_entity(F.col("relation_score"), _time(p), p.semantic_weight, p.temporal_weight)).withColumn("src_ord", F.lit(1)))


def merged_entities(*parts: DataFrame) -> DataFrame:
    """All parts, each node from the part with the least src_ord."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return keep_first(out, ["node_id"], ["src_ord", "place", F.desc("score")])


def merged_relations(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return keep_first(out, ["src", "dst", "type"], ["src_ord", "place", F.desc("score")])


def hop(g: Graph, frontier: DataFrame, visited: DataFrame, p: QueryParams, number: int) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of one step along out-edges: best per neighbour, then the best max_neighbors times the frontier."""
    f = frontier.select(F.col("node_id").alias("from"), F.col("embedding").alias("from_embedding"))
    e = g.edges.select(F.col("src").alias("from"), F.col("dst").alias("node_id"), "is_temporal")
    pairs = e.join(F.broadcast(f), "from").groupBy("from", "node_id").agg(F.bool_or("is_temporal").alias("temporal"), F.first("from_embedding").alias("from_embedding"))
    pairs = pairs.join(F.broadcast(visited.select("node_id")), "node_id", "left_anti")
    near = pairs.join(g.nodes.filter("node_type = 'entity'"), "node_id").join(g.node_centrality.select("node_id", "centrality"), "node_id", "left")
    if p.months:
        near = near.filter(neighbor_in(F.col("date"), F.col("temporal"), p.months, "strict" if p.temporal_expansion_mode == "expanded" else p.temporal_expansion_mode, p.temporal_evolution_scope))
    cos = V.cosine(F.col("embedding"), F.col("from_embedding"))
    near = near.withColumn("score", S.neighbour(cos, _time(p), F.col("centrality"), number, F.col("temporal"), p.semantic_weight, p.temporal_weight))
    best = keep_first(near, ["node_id"], [F.desc("score"), "from"])
    chosen = beam(best, frontier, p.max_neighbors, "score", "first_ord", "node_id")
    chosen = chosen.withColumns({"src_ord": F.lit(2 + number), "semantic": F.lit(None).cast("double"), "place": F.row_number().over(_order(F.desc("score"), "first_ord", "node_id"))})
    c = chosen.select(F.col("from").alias("src"), F.col("node_id").alias("dst"), F.col("from_embedding").alias("_es"), F.col("embedding").alias("_ed"), F.col("place"))
    edges = g.edges.join(F.broadcast(c), ["src", "dst"]).join(g.edge_centrality.select("src", "dst", F.col("betweenness").alias("_c")), ["src", "dst"], "left")
    sem = S.edge_semantic(V.cosine(F.col("embedding"), F.col("_es")), V.cosine(F.col("embedding"), F.col("_ed")), F.col("description"))
    scored = _relation(edges).withColumns({"score": S.edge(sem, _time(p), F.col("_c"), number, p.semantic_weight, p.temporal_weight), "semantic": sem, "src_ord": F.lit(2 + number)})
    return _entities(chosen), scored.select(*RELATION, "score", "semantic", "src_ord", "place")


def expand(g: Graph, entities: DataFrame, p: QueryParams, seeds: int = 3, keep=lambda df: df) -> tuple[DataFrame, DataFrame] | None:
    """The hops from the first entities. keep is applied to each small step's result (a cache or checkpoint)."""
    frontier = visited = keep(entities.orderBy("src_ord", "place", "node_id").limit(seeds))
    found: list[tuple[DataFrame, DataFrame]] = []
    for number in range(p.max_hops if p.enable_multi_hop else 0):
        got, rel = hop(g, frontier, visited, p, number)
        got = keep(got)
        found.append((got, rel))
        visited = visited.select("node_id").union(got.select("node_id"))
        frontier = got
    if not found:
        return None
    ents, rels = found[0]
    for a, b in found[1:]:
        ents, rels = ents.unionByName(a), rels.unionByName(b)
    return ents, rels


def retrieve(g: Graph, entity_query: Sequence[float] | None, relation_query: Sequence[float] | None, p: QueryParams, keywords: tuple[list[str], list[str]] = ([], []), keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(entities, relations), each top k. Without vectors, keywords (high, low level) are matched in texts."""
    p = p.normal()
    high, low = keywords
    direct = entity_search(g.nodes, entity_query, p) if entity_query is not None else entity_text_search(g.nodes, low or high, p)
    relations = relation_search(g.edges, relation_query, p) if relation_query is not None else relation_text_search(g.edges, high, p)
    relations = keep(relations)
    entities = merged_entities(direct, connected_entities(relations, g.nodes, p))
    if p.months:
        entities = entities.filter(F.col("date").isin(p.months))
        relations = relations.filter(edge_in(p.months, p.temporal_evolution_scope))
    entities = keep(entities)
    more = expand(g, entities, p, keep=keep)
    if more is not None:
        entities, relations = merged_entities(entities, more[0]), merged_relations(relations, more[1])
    entities = entities.orderBy(F.desc("score"), "src_ord", "place", "node_id").limit(p.top_k)
    return entities, relations.orderBy(F.desc("score"), "src_ord", "place", "src", "dst", "type").limit(p.top_k)


def primary_chunks(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Chunks of results, by their best score."""
    ids = entities.select("chunk_id", "score").union(relations.select("chunk_id", "score")).filter("chunk_id is not null").groupBy("chunk_id").agg(F.max("score").alias("score"))
    return chunks.join(F.broadcast(ids), "chunk_id").select("chunk_id", "content", "score")


def supplementary_chunks(chunks: DataFrame, primary: DataFrame, months: list[str], most: int = 3) -> DataFrame:
    """Other chunks of the months, as many as there are primary ones but ``most`` at most, by chunk_id."""
    from tempoloom.functions.timefn import month_in_id

    rest = chunks.withColumn("chunk_month", month_in_id(F.col("chunk_id"))).filter(F.col("chunk_month").isin(months)).join(F.broadcast(primary.select("chunk_id")), "chunk_id", "left_anti")
    few = rest.orderBy("chunk_id").limit(most).withColumn("_rn", F.row_number().over(_order("chunk_id")))
    size = primary.agg(F.count("*").alias("_n"))
    return few.crossJoin(F.broadcast(size)).filter("_rn <= _n").select("chunk_id", "content", F.lit(0.0).alias("score"))
