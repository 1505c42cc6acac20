"""The engine: insert documents, link months, ask, save and load."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoloom.functions.timefn import expand, stamped
from tempoloom.functions.vectorfn import embedder, hashed
from tempoloom.operators import centrality, chunking, graph, knn
from tempoloom.plans import context
from tempoloom.plans.params import CentralityParams, ChunkParams, QueryParams
from tempoloom.plans.retrieve import Graph, primary_chunks, retrieve, supplementary_chunks
from tempoloom.sources import extract, files, workspace


@dataclass
class Result:
    answer: str
    entities: list
    relations: list
    chunks: list
    token_stats: dict[str, int]
    keywords: dict[str, object]
    error: str | None = None


class Engine:
    """Tables live as DataFrames; build() derives the graph from all mentions and must follow insertions."""

    def __init__(
        self, spark: SparkSession, model: Callable[[str, str], str] = extract.rule_extractor, encode: Callable = hashed, keywords: Callable = extract.rule_keywords, answer: Callable[[str, str], str] = lambda system, prompt: prompt,
        chunks: ChunkParams = ChunkParams(), ranks: CentralityParams = CentralityParams(), ontology: extract.Ontology = extract.ONTOLOGY, prompts: dict[str, str] | None = None,
    ):
        """prompts may replace the texts "extract" (with {types}) and "answer" (with {time}, {context} and {question})."""
        self.spark, self.model, self.encode, self.ask_keywords, self.answer, self.chunking, self.ranks, self.ontology = spark, model, encode, keywords, answer, chunks, ranks, ontology
        self.prompts = {"extract": extract.EXTRACT, "answer": extract.ANSWERING} | (prompts or {})
        self.tables: dict[str, DataFrame] = {}

    @property
    def mentions(self) -> tuple[DataFrame, DataFrame] | None:
        return (self.tables["entity_mentions"], self.tables["relation_mentions"]) if "entity_mentions" in self.tables else None

    def insert(self, documents: DataFrame) -> None:
        """documents: doc_id, text, date, doc_ord. A document that is there already is replaced; of several with one doc_id the last by doc_ord counts."""
        c = self.chunking
        own = documents.filter("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("text", "date", "doc_ord"), F.struct("doc_ord", "text")).alias("r")).select("doc_id", "r.*")
        if c.sentence_boundary:
            chunks = chunking.sentence_chunks(own, c.max_tokens, c.overlap_tokens, c.min_tokens)
        else:
            chunks = chunking.char_windows(own, c.max_tokens, c.overlap_tokens, c.min_tokens)
        chunks = stamped(chunks.join(own.select("doc_id", "date", "doc_ord"), "doc_id"))
        answers = centrality.checkpoint(extract.asked(chunks, self.model, self.ontology, self.prompts["extract"]))
        new = {"chunks": answers.drop("answer"), "entity_mentions": extract.entity_mentions(answers), "relation_mentions": extract.relation_mentions(answers)}
        ids = centrality.checkpoint(own.select("doc_id"))
        for name, rows in new.items():
            key = "doc_id" if name == "chunks" else "source_doc_id"
            old = self.tables.get(name)
            gone = ids.select(F.col("doc_id").cast(rows.schema[key].dataType).alias(key))
            self.tables[name] = rows if old is None else old.join(gone, key, "left_anti").select(*rows.columns).unionByName(rows)

    def insert_files(self, path: str | list[str], log: str, pattern: str = "*", recursive: bool = True, **readers: Callable[[bytes], str]) -> dict[str, object]:
        """Reads what the log hasn't, inserts it and logs it; gives the run's statistics."""
        began = time.time()
        found, known = files.scan(self.spark, path, pattern, recursive), files.read_log(self.spark, log)
        docs = centrality.checkpoint(files.documents(found if known is None else files.unread(found, known), **readers))
        good = docs.filter("error is null")
        if good.limit(1).count():
            order = F.col("date").isNotNull().cast("long")
            self.insert(good.select("doc_id", "text", "date", order.alias("doc_ord")))
        files.write_log(docs, log, time.time() - began)
        return files.ingest_stats(docs).first().asDict() | {"seconds": time.time() - began}

    def build(self, links: bool = True) -> None:
        if self.mentions is None:
            raise ValueError("nothing was inserted")
        embed = embedder(self.encode)
        entities, relations = self.mentions
        nodes = graph.merge_nodes(entities).withColumn("embedding", embed(F.concat_ws("\n", "name", "description")))
        nodes = centrality.checkpoint(nodes)
        edges = graph.merge_edges(graph.accepted_relations(relations, nodes))
        if links:
            edges = edges.unionByName(graph.temporal_links(nodes, edges))
        edges = centrality.checkpoint(edges.withColumn("embedding", embed(F.concat_ws(" ", F.array_join("relation_keywords", " "), "description"))))
        of_node, of_edge = centrality.combined(nodes, edges, self.ranks.node_pivots, self.ranks.edge_pivots, self.ranks.pagerank_iterations)
        self.tables |= {"nodes": nodes, "edges": edges, "node_centrality": centrality.checkpoint(of_node), "edge_centrality": centrality.checkpoint(of_edge)}

    def build_temporal_links(self) -> int:
        """Adds the links that are missing; gives how many."""
        new = centrality.checkpoint(graph.temporal_links(self.tables["nodes"], self.tables["edges"]))
        embed = embedder(self.encode)
        self.tables["edges"] = self.tables["edges"].unionByName(new.withColumn("embedding", embed(F.concat_ws(" ", F.array_join("relation_keywords", " "), "description"))))
        return new.count()

    def query(self, question: str, params: QueryParams = QueryParams()) -> Result:
        try:
            p = params.normal()
        except ValueError as e:
            return Result("", [], [], [], {}, {}, str(e))
        try:
            high, low = self.ask_keywords(question)
        except Exception:  # noqa: BLE001 - a failed call gives no keywords
            high, low = [], []
        t = self.tables
        g = Graph(t["nodes"], t["edges"], t["node_centrality"], t["edge_centrality"])
        words = " ".join([*high, *low])
        entities, relations = retrieve(g, self.encode(words) if words else None, self.encode(" ".join(high)) if high else None, p, (high, low), keep=centrality.checkpoint)
        entities, relations = centrality.checkpoint(entities), centrality.checkpoint(relations)
        stored = t["chunks"] if "chunks" in t else self.spark.createDataFrame([], "chunk_id string, content string")
        primary = primary_chunks(stored, entities, relations)
        chunks = primary.unionByName(supplementary_chunks(stored, primary, list(p.months))) if p.months else primary
        chunks = centrality.checkpoint(chunks)
        when = context.time_line(expand(p.time_range, "adjacent")) if p.time_range else ""
        base = len(extract.fill(self.prompts["answer"], time=when, context="", question=question)) // 4
        b = context.budgets(base, p)
        named = relations.join(t["nodes"].select(F.col("node_id").alias("src"), F.col("name").alias("source")), "src").join(t["nodes"].select(F.col("node_id").alias("dst"), F.col("name").alias("target")), "dst")
        parts = [
            context.section(context.entity_lines(entities, b.entity), "running").first(),
            context.section(context.relation_lines(named, b.relation), "running").first(),
            context.section(context.chunk_lines(chunks, b.chunk, order=(F.desc("score"), "chunk_id")), "number", "\n\n").first(),
        ]
        prompt = extract.fill(self.prompts["answer"], time=when, context=context.joined(*[x.text for x in parts]), question=question)
        stats = {"total_tokens": base + sum(x.tokens for x in parts), "base_prompt_tokens": base, "available_tokens": b.available}
        for name, x in zip(("entities", "relations", "chunks"), parts):
            stats |= {f"{name}_tokens": x.tokens, f"{name}_count": x.lines}
        text, error = "", None
        try:
            text = self.answer("", prompt)
        except Exception as e:  # noqa: BLE001 - what was found is given all the same
            error = f"{type(e).__name__}: {e}"
        return Result(text, entities.drop("embedding").collect(), relations.collect(), chunks.collect(), stats, {"original_query": question, "high_level_keywords": high, "low_level_keywords": low}, error)

    def search(self, text: str, k: int = 10, where: dict[str, object] | None = None, metric: str = "cosine") -> DataFrame:
        """The k entities nearest to a text that meet the filter, with their score."""
        own = self.tables["nodes"].filter("node_type = 'entity'")
        return knn.search(own, self.encode(text), k, metric, where, key="node_id")

    def save(self, path: str) -> dict[str, str]:
        """The engine reads from what it saved from then on."""
        paths = workspace.save(path, self.tables)
        self.tables = workspace.load(self.spark, path, ())[0]
        return paths

    def load(self, path: str) -> dict[str, bool]:
        """Documents may be inserted after it: mentions are saved too, and build() derives the graph from all of them."""
        self.tables, there = workspace.load(self.spark, path)
        return there

    def stats(self) -> dict[str, object]:
        t = self.tables
        row = graph.totals(t["nodes"], t["edges"]).first().asDict()
        chunks = t["chunks"].agg(F.count("*"), F.count_distinct("doc_id")).first() if "chunks" in t else (0, 0)
        mentions = [x.count() for x in self.mentions] if self.mentions else [0, 0]
        return row | {"stored_chunks": chunks[0], "documents": chunks[1], "entity_mentions": mentions[0], "relation_mentions": mentions[1]}
