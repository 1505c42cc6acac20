"""Queries of the engine's operators over the driver's tables, and the same in SQL.

The graph is that of orders: nations and market segments are entities, each order mentions one of both, in its month.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoloom.functions import scoring, textfn, timefn, vectorfn
from tempoloom.operators import centrality, chunking, filters, graph, knn, ranking
from tempoloom.plans import context, retrieve
from tempoloom.plans.engine import Engine
from tempoloom.plans.params import CentralityParams, ChunkParams, QueryParams
from tempoloom.sources import extract, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MONTHS = ["1996-03", "1997-11"]
WORDS = ["the", "ing", "idiot", "MIT"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the graph of orders


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", timefn.month_of(F.col("o_orderdate")).alias("d"))
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("order_"), F.col("o_orderkey"))
    both = F.array(
        F.struct(F.col("n_name").alias("name"), F.lit("GEOGRAPHIC").alias("type"), F.col("o_orderpriority").alias("description"), (F.col("o_orderkey") * 2).alias("ord")),
        F.struct(F.col("c_mktsegment").alias("name"), F.lit("MARKET").alias("type"), F.col("o_orderstatus").alias("description"), (F.col("o_orderkey") * 2 + 1).alias("ord")),
    )
    chunk = F.concat(doc, F.lit("_"), F.col("d"), F.lit("_chunk_0"))
    return orders(spark, sf_dir).select(F.inline(both), doc.alias("source_doc_id"), chunk.alias("chunk_id"), F.col("d").alias("date"), F.col("o_orderkey").alias("doc_ord"))


def relation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("order_"), F.col("o_orderkey"))
    return orders(spark, sf_dir).select(
        F.col("n_name").alias("source"), F.col("c_mktsegment").alias("target"), F.col("o_orderpriority").alias("keywords"), F.col("o_orderstatus").alias("description"),
        F.concat(doc, F.lit("?")).alias("evidence"), doc.alias("source_doc_id"), F.concat(doc, F.lit("_"), F.col("d"), F.lit("_chunk_0")).alias("chunk_id"),
        F.col("d").alias("date"), F.col("o_orderkey").alias("doc_ord"), F.col("o_orderkey").alias("ord"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_nodes(entity_mentions(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str, links: bool = True) -> DataFrame:
    e = graph.merge_edges(relation_mentions(spark, sf_dir))
    return e.unionByName(graph.temporal_links(nodes(spark, sf_dir), e)) if links else e


def _built(spark: SparkSession, sf_dir: str, links: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, each computed once."""
    n = centrality.checkpoint(nodes(spark, sf_dir))
    e = centrality.checkpoint(graph.merge_edges(relation_mentions(spark, sf_dir)))
    return n, centrality.checkpoint(e.unionByName(graph.temporal_links(n, e))) if links else e


def with_vectors(df: DataFrame, spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    v = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col("first_ord") + shift, F.col("_n"))).join(v, "vec_id").drop("vec_id", "_n")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(t(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


G = """
j AS (SELECT o_orderkey, n_name, c_mktsegment, o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m') AS d
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
em AS (SELECT n_name AS name, 'GEOGRAPHIC' AS type, o_orderpriority AS description, o_orderkey * 2 AS ord, o_orderkey AS doc_ord, d AS date, 'order_' || o_orderkey AS doc FROM j
  UNION ALL SELECT c_mktsegment, 'MARKET', o_orderstatus, o_orderkey * 2 + 1, o_orderkey, d, 'order_' || o_orderkey FROM j),
nodes AS (SELECT name || '__' || date AS node_id, any_value(name) AS name, arg_min(type, ord) AS type, string_agg(description, chr(10) || '---' || chr(10) ORDER BY ord) AS description,
  count(DISTINCT doc) AS docs, any_value(date) AS date, arg_min(doc, ord) || '_' || any_value(date) || '_chunk_0' AS chunk_id, min(ord) AS first_ord,
  any_value(substr(date, 1, 4)::INT * 12 + substr(date, 6, 2)::INT) AS month_idx FROM em GROUP BY 1),
rm AS (SELECT n_name || '__' || d AS src, c_mktsegment || '__' || d AS dst, o_orderpriority AS keyword, o_orderstatus AS description, 'order_' || o_orderkey AS doc, o_orderkey AS ord, d AS date FROM j),
kw AS (SELECT src, dst, list(keyword ORDER BY o) AS ks FROM (SELECT src, dst, keyword, min(ord) AS o FROM rm GROUP BY ALL) GROUP BY ALL),
sem AS (SELECT src, dst, array_to_string(ks, ', ') AS type, string_agg(keyword || ': ' || description, chr(10) ORDER BY ord) AS description,
  string_agg(doc || '?', chr(10) ORDER BY ord) AS evidence, arg_min(doc, ord) AS source_doc_id, arg_min(doc, ord) || '_' || any_value(date) || '_chunk_0' AS chunk_id, any_value(date) AS date, min(ord) AS first_ord
  FROM rm JOIN kw USING (src, dst) GROUP BY src, dst, ks),
links AS (SELECT a.node_id AS src, b.node_id AS dst, lower(a.name) || ' evolves from ' || a.date || ' to ' || b.date AS description, 1 - (b.month_idx - a.month_idx) / 5.0 AS time_similarity, a.date AS time_1, b.date AS time_2, b.first_ord
  FROM nodes a JOIN nodes b ON lower(a.name) = lower(b.name) AND a.type = b.type AND b.month_idx BETWEEN a.month_idx AND a.month_idx + 3
  AND (b.month_idx > a.month_idx OR (a.first_ord, a.node_id) < (b.first_ord, b.node_id)) WHERE NOT EXISTS (SELECT 1 FROM sem WHERE sem.src = a.node_id AND sem.dst = b.node_id)),
edges AS (SELECT src, dst, type, description, date, chunk_id, first_ord, false AS is_temporal FROM sem UNION ALL SELECT src, dst, 'temporal_evolution', description, NULL, NULL, first_ord, true FROM links),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), vn AS (SELECT count(*) AS vn FROM embeddings),
nv AS (SELECT nodes.*, embedding::DOUBLE[] AS v FROM nodes, vn JOIN embeddings e ON e.vec_id = first_ord % vn),
ev AS (SELECT sem.*, embedding::DOUBLE[] AS v FROM sem, vn JOIN embeddings e ON e.vec_id = (first_ord + 7) % vn)"""
REL = f"greatest(0.0, 1 - list_min([abs({' - mi), abs('.join(str(timefn.index_of(m)) for m in MONTHS)} - mi)]) / 5.0)"


def rel(mi: str) -> str:
    return REL.replace(" - mi", f" - ({mi})")


MI = "substr(date, 1, 4)::INT * 12 + substr(date, 6, 2)::INT"
CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


# --- text and chunks


@query(f"SELECT doc_id, length(c)::BIGINT AS characters, (length(c) // 4)::BIGINT AS tokens, md5(c) AS digest FROM (SELECT doc_id, {CLEAN} AS c FROM documents)")
def doc_clean_and_token_count(spark, sf_dir):
    c = textfn.clean(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("characters"), textfn.token_count(c).cast("long").alias("tokens"), F.md5(c).alias("digest"))


WINDOWS = f"""SELECT doc_id || '_chunk_' || i AS chunk_id, i AS chunk_index, length(x) // 4 AS token_count, md5(x) AS digest FROM (
  SELECT doc_id, i, substring(c, (i * 1800 + 1)::BIGINT, 2000) AS x FROM (SELECT doc_id, c, unnest(range(0, greatest(1, ceil((length(c) - 2000) / 1800.0)::BIGINT + 1))) AS i FROM (SELECT doc_id, {CLEAN} AS c FROM documents) WHERE c <> '')) WHERE length(x) // 4 >= 100"""


@query(WINDOWS)
def doc_char_windows(spark, sf_dir):
    c = chunking.char_windows(t(spark, sf_dir, "documents"), min_tokens=chunking.MIN)
    return c.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"), F.md5("content").alias("digest"))


@query(f"SELECT count(*) AS chunks, coalesce(sum(token_count), 0)::BIGINT AS tokens, round(coalesce(avg(token_count), 0), 6) AS mean_tokens, coalesce(min(token_count), 0)::BIGINT AS min_tokens, coalesce(max(token_count), 0)::BIGINT AS max_tokens FROM ({WINDOWS})")
def chunk_stats(spark, sf_dir):
    s = chunking.stats(chunking.char_windows(t(spark, sf_dir, "documents"), min_tokens=chunking.MIN))
    return s.select("chunks", "tokens", F.round("mean_tokens", 6).alias("mean_tokens"), F.col("min_tokens").cast("long").alias("min_tokens"), F.col("max_tokens").cast("long").alias("max_tokens"))


@query(f"SELECT doc_id, i AS window, md5(array_to_string(w[i * 450 + 1 : i * 450 + 500], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 500) / 450.0)::BIGINT + 1))) AS i FROM (SELECT doc_id, string_split({CLEAN}, ' ') AS w FROM documents WHERE {CLEAN} <> ''))")
def doc_token_windows(spark, sf_dir):
    c = chunking.token_windows(t(spark, sf_dir, "documents"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("window"), F.md5("content").alias("digest"))


@query(r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-Z])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> ''))::BIGINT AS sentences FROM documents""")
def doc_sentence_split(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.size(textfn.sentences(F.col("text"))).cast("long").alias("sentences"))


@query()
def doc_sentence_chunks(spark, sf_dir):
    return chunking.sentence_chunks(t(spark, sf_dir, "documents"))


@query("SELECT doc_id, CASE WHEN length(text) // 4 > 50 THEN substring(text, 1, 200) || '...' ELSE text END AS cut, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS preview FROM documents")
def text_truncation(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", textfn.truncate_tokens(F.col("text"), 50).alias("cut"), textfn.preview(F.col("text"), 120).alias("preview"))


@query("SELECT doc_id, round((" + " + ".join(f"contains(lower(text), '{w.lower()}')::INT" for w in WORDS) + f") / {len(WORDS)}.0, 6) AS score FROM documents")
def text_match(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.round(textfn.match_share(F.col("text"), WORDS), 6).alias("score"))


# --- months

MS = "m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS date FROM orders), mi AS (SELECT date, " + MI + " AS i FROM m)"


def months(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(timefn.month_of(F.col("o_orderdate")).alias("date")).distinct()


@query(f"WITH {MS} SELECT a.date AS month_1, b.date AS month_2, a.i::INT AS index_1, round(CASE WHEN abs(a.i - b.i) <= 4 THEN 1 - abs(a.i - b.i) / 5.0 ELSE 0 END, 6) AS similarity, abs(a.i - b.i) = 1 AS adjacent FROM mi a, mi b")
def month_similarity(spark, sf_dir):
    a = months(spark, sf_dir).select(F.col("date").alias("month_1"), timefn.month_index(F.col("date")).alias("index_1"))
    b = a.select(F.col("month_1").alias("month_2"), F.col("index_1").alias("index_2"))
    return a.crossJoin(b).select("month_1", "month_2", "index_1", F.round(timefn.similarity(F.col("index_1"), F.col("index_2")), 6).alias("similarity"), timefn.is_adjacent(F.col("index_1"), F.col("index_2")).alias("adjacent"))


NAME = "printf('%04d-%02d', (i - 1) // 12, (i - 1) % 12 + 1)"


@query(f"WITH {MS}, x AS (SELECT DISTINCT i + unnest([-1, 0, 1]) AS i FROM mi) SELECT {NAME} AS month, i::INT AS month_idx FROM x")
def adjacent_months(spark, sf_dir):
    return timefn.expanded_months(months(spark, sf_dir), "date", "adjacent")


@query(f"WITH {MS}, x AS (SELECT unnest(range(min(i), max(i) + 1)) AS i FROM mi) SELECT {NAME} AS month, i::INT AS month_idx FROM x")
def month_span(spark, sf_dir):
    return timefn.expanded_months(months(spark, sf_dir), "date", "expanded")


@query(f"WITH {MS} SELECT date, {NAME.replace('i ', '(i - 1) ')} || ',' || date || ',' || {NAME.replace('i ', '(i + 1) ')} AS around FROM mi")
def temporal_neighbours(spark, sf_dir):
    return months(spark, sf_dir).select("date", F.array_join(timefn.temporal_neighbours(F.col("date")), ",").alias("around"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS found, strftime(o_orderdate, '%Y-%m') AS in_id, quarter_name AS quarter, printf('%04d-%02d', year(o_orderdate), quarter(o_orderdate) * 3) AS quarter_month
  FROM (SELECT *, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter_name FROM orders)""")
def time_in_text(spark, sf_dir):
    m, key = timefn.month_of(F.col("o_orderdate")), F.col("o_orderkey").cast("string")
    path = F.concat(F.lit("rep_"), m, F.lit("_x.txt"))
    quarter = F.concat(F.lit("rep Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate"), F.lit(".md"))
    found = timefn.find_time(quarter, F.lit(""))
    return t(spark, sf_dir, "orders").select("o_orderkey", timefn.find_time(path, key).alias("found"), timefn.month_in_id(F.concat(F.lit("d_"), m, F.lit("_chunk_"), F.lit("0"))).alias("in_id"), found.alias("quarter"), timefn.to_month(found).alias("quarter_month"))


# --- the graph


@query(f"WITH {G} SELECT node_id, name, type, description, docs::BIGINT AS docs, date, chunk_id, first_ord, month_idx::INT AS month_idx FROM nodes")
def node_merge(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_id", "name", "type", "description", F.size("source_doc_ids").cast("long").alias("docs"), "date", "chunk_id", "first_ord", "month_idx")


@query(f"WITH {G} SELECT src, dst, type AS keywords, description, evidence, source_doc_id, chunk_id, date, first_ord FROM sem")
def edge_merge(spark, sf_dir):
    return edges(spark, sf_dir, False).select("src", "dst", F.array_join("relation_keywords", ", ").alias("keywords"), "description", "evidence", "source_doc_id", "chunk_id", "date", "first_ord")


FEW = "few AS (SELECT name || '__' || date AS node_id, min(doc_ord) AS o FROM em WHERE ord % 3 = 0 GROUP BY 1)"


def few_nodes(spark, sf_dir):
    return graph.merge_nodes(entity_mentions(spark, sf_dir).filter("ord % 3 = 0"))


# the same four over the nodes of all mentions; the SQL of those over a third of the mentions stays as it is

FIRST = "first AS (SELECT name || '__' || date AS node_id, min(doc_ord) AS o FROM em GROUP BY 1)"


@query(f"WITH {G}, {FIRST} SELECT src, dst, count(*) AS n FROM rm WHERE src IN (SELECT node_id FROM first) AND dst IN (SELECT node_id FROM first) GROUP BY ALL")
def relation_endpoint_check_all(spark, sf_dir):
    ok = graph.accepted_relations(relation_mentions(spark, sf_dir), nodes(spark, sf_dir))
    return ok.groupBy(graph.node_id(F.col("source"), F.col("date")).alias("src"), graph.node_id(F.col("target"), F.col("date")).alias("dst")).agg(F.count("*").alias("n"))


@query(f"WITH {G}, {FIRST} SELECT count(*) AS n FROM rm JOIN first a ON a.node_id = src AND a.o <= rm.ord JOIN first b ON b.node_id = dst AND b.o <= rm.ord")
def relation_endpoint_check_in_order_all(spark, sf_dir):
    return graph.accepted_relations(relation_mentions(spark, sf_dir), nodes(spark, sf_dir), strict=True).agg(F.count("*").alias("n"))


@query(f"WITH {G}, {FIRST} SELECT ord AS order_key FROM rm WHERE src NOT IN (SELECT node_id FROM first) OR dst NOT IN (SELECT node_id FROM first)")
def rejected_relations_all(spark, sf_dir):
    return graph.rejected_relations(relation_mentions(spark, sf_dir), nodes(spark, sf_dir)).select(F.col("ord").alias("order_key"))


@query(f"""WITH {G}, used AS (SELECT src AS s FROM sem UNION SELECT dst FROM sem) SELECT 'missing_node' AS rule, 'issue' AS severity, s AS subject FROM used WHERE s NOT IN (SELECT node_id FROM nodes)
  UNION ALL SELECT 'isolated', 'warning', node_id FROM nodes WHERE node_id NOT IN (SELECT s FROM used)""")
def graph_validate_all(spark, sf_dir):
    return graph.validation(nodes(spark, sf_dir), edges(spark, sf_dir, False))


@query(f"WITH {G}, {FEW} SELECT src, dst, count(*) AS n FROM rm WHERE src IN (SELECT node_id FROM few) AND dst IN (SELECT node_id FROM few) GROUP BY ALL")
def relation_endpoint_check(spark, sf_dir):
    ok = graph.accepted_relations(relation_mentions(spark, sf_dir), few_nodes(spark, sf_dir))
    return ok.groupBy(graph.node_id(F.col("source"), F.col("date")).alias("src"), graph.node_id(F.col("target"), F.col("date")).alias("dst")).agg(F.count("*").alias("n"))


@query(f"WITH {G}, {FEW} SELECT count(*) AS n FROM rm JOIN few a ON a.node_id = src AND a.o <= rm.ord JOIN few b ON b.node_id = dst AND b.o <= rm.ord")
def relation_endpoint_check_in_order(spark, sf_dir):
    return graph.accepted_relations(relation_mentions(spark, sf_dir), few_nodes(spark, sf_dir), strict=True).agg(F.count("*").alias("n"))


@query(f"WITH {G}, {FEW} SELECT ord AS order_key FROM rm WHERE src NOT IN (SELECT node_id FROM few) OR dst NOT IN (SELECT node_id FROM few)")
def rejected_relations(spark, sf_dir):
    return graph.rejected_relations(relation_mentions(spark, sf_dir), few_nodes(spark, sf_dir)).select(F.col("ord").alias("order_key"))


@query(f"WITH {G} SELECT src, dst, description, round(time_similarity, 6) AS time_similarity, time_1, time_2 FROM links")
def temporal_links(spark, sf_dir):
    e = graph.temporal_links(*_built(spark, sf_dir, False))
    return e.select("src", "dst", "description", F.round("time_similarity", 6).alias("time_similarity"), "time_1", "time_2")


@query(f"WITH {G} SELECT node_id, date, (month_idx - lag(month_idx) OVER (ORDER BY date, node_id))::INT AS months_since FROM nodes WHERE lower(name) = 'building'")
def entity_timeline(spark, sf_dir):
    return graph.timeline(nodes(spark, sf_dir), "Building").select("node_id", "date", "months_since")


@query(f"""WITH {G}, a AS (SELECT count(*) AS n FROM nodes), b AS (SELECT count(*) AS m, count(*) FILTER (is_temporal) AS tm FROM edges)
  SELECT n AS num_nodes, n AS dated_nodes, n AS entity_nodes, m AS num_edges, tm AS temporal_edges, round(2.0 * m / n, 2) AS avg_degree, round(m::DOUBLE / (n * (n - 1)), 4) AS density FROM a, b""")
def graph_totals(spark, sf_dir):
    return graph.totals(*_built(spark, sf_dir))


@query(f"WITH {G} SELECT k AS keyword, count(*) AS n FROM (SELECT unnest(string_split(type, ', ')) AS k FROM edges) GROUP BY 1")
def relation_keyword_counts(spark, sf_dir):
    return graph.counts_by_keyword(_built(spark, sf_dir)[1])


@query(f"WITH {G} SELECT type, count(*) AS n FROM nodes GROUP BY 1")
def entity_type_counts(spark, sf_dir):
    return graph.counts_by_entity_type(nodes(spark, sf_dir))


@query(f"WITH {G} SELECT 'entity' AS node_type, count(*) AS n FROM nodes")
def node_type_counts(spark, sf_dir):
    return graph.counts_by_type(nodes(spark, sf_dir))


@query(f"""WITH {G}, {FEW} SELECT 'missing_node' AS rule, 'issue' AS severity, s AS subject FROM (SELECT src AS s FROM sem UNION SELECT dst FROM sem) WHERE s NOT IN (SELECT node_id FROM few)""")
def graph_validate(spark, sf_dir):
    return graph.validation(few_nodes(spark, sf_dir), edges(spark, sf_dir, False))


@query(f"WITH {G} SELECT node_id, type FROM nodes JOIN (SELECT DISTINCT dst FROM rm WHERE src = 'CHINA__1996-03' AND keyword IN ('1-URGENT', '5-LOW')) ON dst = node_id")
def neighbors_filtered(spark, sf_dir):
    return graph.neighbors(*_built(spark, sf_dir), "CHINA__1996-03", ["1-URGENT", "5-LOW"]).select("node_id", "type")


@query(f"WITH {G} SELECT node_id, round(coalesce(d, 0)::DOUBLE / ((SELECT count(*) FROM nodes) - 1), 9) AS degree FROM nodes LEFT JOIN (SELECT x, count(*) AS d FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) ON x = node_id")
def degree_centrality(spark, sf_dir):
    return centrality.degree(*_built(spark, sf_dir)).select("node_id", F.round("degree", 9).alias("degree"))


def _pagerank_sql(rounds: int) -> str:
    steps = ["w AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS w FROM edges GROUP BY src, dst)", "n AS MATERIALIZED (SELECT node_id, node_id NOT IN (SELECT src FROM w) AS ends, (SELECT count(*) FROM nodes)::DOUBLE AS c FROM nodes)", "r0 AS MATERIALIZED (SELECT node_id, ends, c, 1 / c AS r FROM n)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT node_id, ends, c, 0.15 / c + 0.85 * (coalesce(s, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE ends) / c) AS r FROM n LEFT JOIN (SELECT dst, sum(w * r) AS s FROM w JOIN r{i} ON src = node_id GROUP BY dst) ON dst = node_id)")
    return f"WITH {G}, {', '.join(steps)} SELECT node_id, round(r, 9) AS pagerank FROM r{rounds}"


@query(_pagerank_sql(10))
def pagerank_10_rounds(spark, sf_dir):
    return centrality.pagerank(*_built(spark, sf_dir), iterations=10, tolerance=0).select("node_id", F.round("pagerank", 9).alias("pagerank"))


@query()
def pagerank_all_rounds(spark, sf_dir):
    return centrality.pagerank(*_built(spark, sf_dir), iterations=CentralityParams().pagerank_iterations)


@query()
def betweenness_of_nodes(spark, sf_dir):
    return centrality.betweenness(*_built(spark, sf_dir))[0]


@query()
def betweenness_of_edges(spark, sf_dir):
    return centrality.betweenness(*_built(spark, sf_dir), 50)[1]


@query()
def combined_centrality(spark, sf_dir):
    return centrality.combined(*_built(spark, sf_dir))[0]


@query(f"""WITH RECURSIVE {G}, both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT node_id AS a, node_id AS c FROM nodes WHERE node_id = (SELECT min(node_id) FROM nodes) UNION SELECT b, c FROM walk JOIN both_ USING (a))
  SELECT node_id, coalesce(c, node_id) AS component FROM nodes LEFT JOIN walk ON a = node_id WHERE c IS NOT NULL""")
def component_of_first_node(spark, sf_dir):
    n, e = _built(spark, sf_dir)
    first = n.agg(F.min("node_id").alias("component"))
    return centrality.components(n, e).join(F.broadcast(first), "component").select("node_id", "component")


@query()
def components_of_all_nodes(spark, sf_dir):
    return centrality.components(*_built(spark, sf_dir))


# --- vectors


def _knn_sql(score: str, order: str, where: str = "true") -> str:
    return f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round({score}, 6) AS score FROM embeddings, q WHERE {where} ORDER BY {score} {order}, vec_id LIMIT 10"


def _rounded(df):
    return df.select("vec_id", "label", F.round("score", 6).alias("score"))


V, Q = "embedding::DOUBLE[]", "q"
#: Of 20 lists; vectors without clusters need so many for nine of ten true neighbours (tests/test_graph.py).
PROBES = 14


@query(_knn_sql(f"list_cosine_similarity({V}, {Q})", "DESC"))
def knn_cosine(spark, sf_dir):
    return _rounded(knn.search(t(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 10))


@query(_knn_sql(f"list_distance({V}, {Q})", "ASC"))
def knn_l2(spark, sf_dir):
    return _rounded(knn.search(t(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 10, "l2"))


@query(_knn_sql(f"list_distance({V}, {Q}) ** 2", "ASC"))
def knn_squared_l2(spark, sf_dir):
    return _rounded(knn.search(t(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 10, "squared_l2"))


@query(_knn_sql(f"1 - list_cosine_similarity({V}, {Q})", "ASC"))
def knn_cosine_distance(spark, sf_dir):
    return _rounded(knn.search(t(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 10, "cosine_distance"))


@query(_knn_sql(f"list_cosine_similarity({V}, {Q})", "DESC", "label = 3"))
def knn_filtered(spark, sf_dir):
    return _rounded(knn.search(t(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 10, where={"label": 3}))


@query()
def knn_inverted_lists(spark, sf_dir):
    listed, centroids = knn.inverted_lists(t(spark, sf_dir, "embeddings"), 20)
    return knn.neighbors(listed, centroids, 10, PROBES).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS total_vectors, max(len(embedding))::INT AS dimension, round(sum(len(embedding) * 4) / 1048576.0, 6) AS memory_mb FROM embeddings")
def vector_stats(spark, sf_dir):
    return knn.stats(t(spark, sf_dir, "embeddings")).withColumn("memory_mb", F.round("memory_mb", 6))


@query("SELECT a.label, count(*) AS pairs, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def pairwise_label_similarity(spark, sf_dir):
    return knn.pair_similarity(t(spark, sf_dir, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


# --- search

PARAMS = QueryParams(top_k=10, similarity_threshold=0.05, time_range=tuple(MONTHS)).normal()
ENTITY_SQL = f"""cand AS (SELECT *, round(list_cosine_similarity(v, q), 12) AS s FROM nv, q ORDER BY s DESC, first_ord, node_id LIMIT 30),
  e1 AS (SELECT node_id, date, first_ord, score, row_number() OVER (ORDER BY score DESC, first_ord, node_id) AS place FROM (SELECT *, (0.6 * s + 0.4 * {rel(MI)}) / 1.0 AS score FROM cand) WHERE score >= 0.05 ORDER BY score DESC, first_ord, node_id LIMIT 10)"""
REL_SQL = f"""r1 AS (SELECT src, dst, type, date, score, row_number() OVER (ORDER BY score DESC, first_ord, src, dst) AS place FROM (SELECT ev.*, (0.6 * round(list_cosine_similarity(v, q), 12) + 0.4 * {rel(MI)}) / 1.0 AS score FROM ev, q) WHERE score >= 0.05 ORDER BY score DESC, first_ord, src, dst LIMIT 10)"""
CONN_SQL = f"""ends AS (SELECT src AS node_id, place * 2 AS place, score FROM r1 UNION ALL SELECT dst, place * 2 + 1, score FROM r1),
  e2 AS (SELECT node_id, date, first_ord, 0.8 * ((0.6 * rs + 0.4 * {rel(MI)}) / 1.0) AS score, place FROM nodes JOIN (SELECT node_id, min(place) AS place, arg_min(score, place) AS rs FROM ends GROUP BY 1) USING (node_id))"""


def _vector_graph(spark, sf_dir):
    n, e = _built(spark, sf_dir, False)
    return with_vectors(n, spark, sf_dir), with_vectors(e, spark, sf_dir, 7)


@query(f"WITH {G}, {ENTITY_SQL} SELECT node_id, round(score, 6) AS score, place FROM e1")
def time_aware_entity_search(spark, sf_dir):
    out = retrieve.entity_search(_vector_graph(spark, sf_dir)[0], query_vector(spark, sf_dir), PARAMS)
    return out.select("node_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {G} SELECT node_id, round(score, 6) AS score FROM (SELECT node_id, first_ord, (0.6 * ((contains(lower(name || ' ' || description), 'china')::INT + contains(lower(name || ' ' || description), 'urgent')::INT) / 2.0) + 0.4 * {rel(MI)}) / 1.0 AS score FROM nodes) WHERE score > 0 ORDER BY score DESC, first_ord, node_id LIMIT 10")
def text_match_entity_search(spark, sf_dir):
    return retrieve.entity_text_search(nodes(spark, sf_dir), ["China", "urgent"], PARAMS).select("node_id", F.round("score", 6).alias("score"))


@query(f"WITH {G}, {REL_SQL} SELECT src, dst, type, round(score, 6) AS score, place FROM r1")
def relation_search(spark, sf_dir):
    out = retrieve.relation_search(_vector_graph(spark, sf_dir)[1], query_vector(spark, sf_dir), PARAMS)
    return out.select("src", "dst", "type", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {G}, {REL_SQL}, {CONN_SQL} SELECT node_id, round(score, 6) AS score, place FROM e2")
def entities_from_relations(spark, sf_dir):
    n, e = _vector_graph(spark, sf_dir)
    out = retrieve.connected_entities(retrieve.relation_search(e, query_vector(spark, sf_dir), PARAMS), n, PARAMS)
    return out.select("node_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"WITH {G}, {ENTITY_SQL}, {REL_SQL}, {CONN_SQL}, u AS (SELECT node_id, score, 0 AS src_ord FROM e1 UNION ALL SELECT node_id, score, 1 FROM e2 WHERE node_id NOT IN (SELECT node_id FROM e1)) SELECT node_id, round(score, 6) AS score, src_ord FROM u ORDER BY u.score DESC, src_ord, node_id")
def merge_and_rank(spark, sf_dir):
    n, e = _vector_graph(spark, sf_dir)
    q = query_vector(spark, sf_dir)
    direct = retrieve.entity_search(n, q, PARAMS)
    out = retrieve.merged_entities(direct, retrieve.connected_entities(retrieve.relation_search(e, q, PARAMS), n, PARAMS))
    return out.select("node_id", F.round("score", 6).alias("score"), "src_ord")


IN = ", ".join(f"'{m}'" for m in MONTHS)
NEAR = ", ".join(f"'{m}'" for m in timefn.expand(MONTHS, "adjacent"))


@query(f"WITH {G} SELECT 'strict' AS mode, node_id FROM nodes WHERE date IN ({IN}) UNION ALL SELECT 'expanded', node_id FROM nodes WHERE date IN ({NEAR})")
def node_time_filter(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return filters.nodes_in(n, MONTHS).select(F.lit("strict").alias("mode"), "node_id").union(filters.nodes_in(n, MONTHS, "expanded").select(F.lit("expanded"), "node_id"))


@query(f"WITH {G} SELECT 'cross_time' AS scope, count(*) AS n FROM edges WHERE is_temporal OR date IN ({IN}) UNION ALL SELECT 'within_range', count(*) FROM edges WHERE date IN ({IN})")
def edge_time_filter(spark, sf_dir):
    e = edges(spark, sf_dir)
    return filters.edges_in(e, MONTHS).agg(F.lit("cross_time").alias("scope"), F.count("*").alias("n")).union(filters.edges_in(e, MONTHS, scope="within_range").agg(F.lit("within_range"), F.count("*")))


NO_TIME = QueryParams(top_k=10, similarity_threshold=0.05)
HOP_SQL = """seeds AS (SELECT node_id, v FROM nv, q ORDER BY round(list_cosine_similarity(v, q), 12) DESC, first_ord, node_id LIMIT 3),
 deg AS (SELECT node_id, coalesce(d, 0)::DOUBLE / ((SELECT count(*) FROM nodes) - 1) AS c FROM nodes LEFT JOIN (SELECT x, count(*) AS d FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) ON x = node_id)"""


def _hop_sql(i: int, front: str, seen: str) -> str:
    return f"""h{i} AS (SELECT node_id, score, v FROM (SELECT *, row_number() OVER (ORDER BY score DESC, first_ord, node_id) AS rn FROM (
   SELECT node_id, any_value(v) AS v, any_value(first_ord) AS first_ord, max(score) AS score FROM (SELECT nv.node_id, nv.v, nv.first_ord,
    least(1.0, (0.6 * (0.6 * list_cosine_similarity(nv.v, f.v) + 0.4) + 0.3 * c + 0.08) * 0.8 ** {i} * CASE WHEN tmp THEN 1.2 ELSE 1.0 END) AS score
    FROM (SELECT src, dst, bool_or(is_temporal) AS tmp FROM edges GROUP BY ALL) x JOIN {front} f ON f.node_id = src JOIN nv ON nv.node_id = dst JOIN deg ON deg.node_id = dst WHERE dst NOT IN ({seen})) GROUP BY node_id)) WHERE rn <= 3 * (SELECT count(*) FROM {front}))"""


def _hops(spark, sf_dir, hops):
    n, e = _built(spark, sf_dir)
    n, e = centrality.checkpoint(with_vectors(n, spark, sf_dir)), centrality.checkpoint(with_vectors(e, spark, sf_dir, 7))
    of_node = centrality.checkpoint(centrality.degree(n, e).withColumnRenamed("degree", "centrality"))
    g = retrieve.Graph(n, e, of_node, e.select("src", "dst", F.lit(0.0).alias("betweenness")).distinct())
    seeds = retrieve.entity_search(n, query_vector(spark, sf_dir), NO_TIME)
    ents, _ = retrieve.expand(g, seeds, QueryParams(top_k=10, similarity_threshold=0.05, max_hops=hops), keep=centrality.checkpoint)
    return ents.select("node_id", F.round("score", 6).alias("score"), (F.col("src_ord") - 2).alias("hop"))


@query(f"WITH {G}, {HOP_SQL}, {_hop_sql(0, 'seeds', 'SELECT node_id FROM seeds')} SELECT node_id, round(score, 6) AS score, 0 AS hop FROM h0")
def one_hop_expansion(spark, sf_dir):
    return _hops(spark, sf_dir, 1)


@query(f"WITH {G}, {HOP_SQL}, {_hop_sql(0, 'seeds', 'SELECT node_id FROM seeds')}, {_hop_sql(1, 'h0', 'SELECT node_id FROM seeds UNION SELECT node_id FROM h0')} SELECT node_id, round(score, 6) AS score, 0 AS hop FROM h0 UNION ALL SELECT node_id, round(score, 6), 1 FROM h1")
def two_hop_beam(spark, sf_dir):
    return _hops(spark, sf_dir, 2)


def _full(spark, sf_dir):
    n, e = _built(spark, sf_dir)
    n, e = centrality.checkpoint(with_vectors(n, spark, sf_dir)), centrality.checkpoint(with_vectors(e, spark, sf_dir, 7))
    p = CentralityParams()
    of_node, of_edge = centrality.combined(n, e, p.node_pivots, p.edge_pivots, p.pagerank_iterations)
    q = query_vector(spark, sf_dir)
    return retrieve.retrieve(retrieve.Graph(n, e, centrality.checkpoint(of_node), centrality.checkpoint(of_edge)), q, q, PARAMS, keep=centrality.checkpoint)


@query()
def retrieved_entities(spark, sf_dir):
    return _full(spark, sf_dir)[0].drop("embedding")


@query()
def retrieved_relations(spark, sf_dir):
    return _full(spark, sf_dir)[1]


# --- context


def dated_chunks(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    date = F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), date, F.lit("_chunk_0")).alias("chunk_id"), F.col("text").alias("content"), "doc_id")


CH = "ch AS (SELECT 'doc_' || doc_id || '_2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '_chunk_0' AS chunk_id, text AS content, doc_id FROM documents), pr AS (SELECT chunk_id, content FROM ch WHERE doc_id IN (5, 17, 29, 40))"


@query(f"""WITH {CH} SELECT chunk_id, md5(content) AS digest, true AS is_primary FROM pr
  UNION ALL SELECT * FROM (SELECT chunk_id, md5(content), false FROM ch WHERE regexp_extract(chunk_id, '([0-9]{{4}}-[0-9]{{2}})', 1) IN ('2024-03', '2024-07') AND chunk_id NOT IN (SELECT chunk_id FROM pr) ORDER BY chunk_id LIMIT 3)""")
def chunk_lookup(spark, sf_dir):
    c = dated_chunks(spark, sf_dir)
    found = c.filter(F.col("doc_id").isin(5, 17, 29, 40)).select("chunk_id", F.lit(0.5).alias("score"))
    primary = retrieve.primary_chunks(c, found, found)
    more = retrieve.supplementary_chunks(c, primary, ["2024-03", "2024-07"])
    return primary.select("chunk_id", F.md5("content").alias("digest"), F.lit(True).alias("is_primary")).union(more.select("chunk_id", F.md5("content"), F.lit(False)))


@query(f"""WITH {G}, l AS (SELECT node_id, first_ord, '- **' || name || '** (' || type || ') [' || date || ']: ' || CASE WHEN length(description) // 4 > 200 THEN substring(description, 1, 800) || '...' ELSE description END AS line FROM nodes)
  SELECT node_id, line, running::BIGINT AS running FROM (SELECT *, sum(length(line) // 4) OVER (ORDER BY first_ord DESC, node_id ROWS UNBOUNDED PRECEDING) AS running FROM l) WHERE running <= 5000""")
def token_budget_context(spark, sf_dir):
    return context.entity_lines(nodes(spark, sf_dir).withColumn("score", F.col("first_ord")), 5000).select("node_id", "line", "running")


@query(f"""WITH {G}, l AS (SELECT src, dst, first_ord, '- **' || split_part(src, '__', 1) || '** ' || type || ' **' || split_part(dst, '__', 1) || '** [' || date || ']: ' || CASE WHEN length(description) // 4 > 150 THEN substring(description, 1, 600) || '...' ELSE description END AS line FROM sem)
  SELECT src, dst, line, running::BIGINT AS running FROM (SELECT *, sum(length(line) // 4) OVER (ORDER BY first_ord DESC, src, dst ROWS UNBOUNDED PRECEDING) AS running FROM l) WHERE running <= 5000""")
def relation_budget_context(spark, sf_dir):
    e = _rel_named(edges(spark, sf_dir, False))
    return context.relation_lines(e, 5000).select("src", "dst", "line", "running")


def _rel_named(e):
    return e.withColumns({"score": F.col("first_ord"), "type": F.array_join("relation_keywords", ", "), "source": F.substring_index("src", "__", 1), "target": F.substring_index("dst", "__", 1)})


@query(f"""WITH {CH}, n AS (SELECT *, row_number() OVER (ORDER BY chunk_id) AS i FROM pr), l AS (SELECT chunk_id, i, '**Chunk ' || i || ':** ' || CASE WHEN length(content) // 4 > 300 THEN substring(content, 1, 1200) || '...' ELSE content END AS line FROM n)
  SELECT chunk_id, line, running::BIGINT AS running FROM (SELECT *, sum(length(line) // 4) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS running FROM l) WHERE running <= 1200""")
def chunk_budget_context(spark, sf_dir):
    c = dated_chunks(spark, sf_dir).filter(F.col("doc_id").isin(5, 17, 29, 40))
    return context.chunk_lines(c, 1200).select("chunk_id", "line", "running")


# both over the chunks that a search of the whole table finds; the SQL of those over four documents stays as it is

SHARE = " + ".join(f"contains(lower(content), '{w.lower()}')::INT" for w in WORDS)
FOUND = f"{CH.split(', pr AS')[0]}, pr AS (SELECT chunk_id, content FROM ch ORDER BY {SHARE} DESC, chunk_id LIMIT 10)"


def found_chunks(spark, sf_dir):
    return dated_chunks(spark, sf_dir).withColumn("score", textfn.match_share(F.col("content"), WORDS)).orderBy(F.desc_nulls_last("score"), "chunk_id").limit(10)


@query(f"""WITH {FOUND} SELECT chunk_id, md5(content) AS digest, true AS is_primary FROM pr
  UNION ALL SELECT * FROM (SELECT chunk_id, md5(content), false FROM ch WHERE regexp_extract(chunk_id, '([0-9]{{4}}-[0-9]{{2}})', 1) IN ('2024-03', '2024-07') AND chunk_id NOT IN (SELECT chunk_id FROM pr) ORDER BY chunk_id LIMIT 3)""")
def chunk_lookup_found(spark, sf_dir):
    c, found = dated_chunks(spark, sf_dir), found_chunks(spark, sf_dir).select("chunk_id", "score")
    primary = retrieve.primary_chunks(c, found, found)
    more = retrieve.supplementary_chunks(c, primary, ["2024-03", "2024-07"])
    return primary.select("chunk_id", F.md5("content").alias("digest"), F.lit(True).alias("is_primary")).union(more.select("chunk_id", F.md5("content"), F.lit(False)))


@query(f"""WITH {FOUND}, n AS (SELECT *, row_number() OVER (ORDER BY chunk_id) AS i FROM pr), l AS (SELECT chunk_id, i, '**Chunk ' || i || ':** ' || CASE WHEN length(content) // 4 > 120 THEN substring(content, 1, 480) || '...' ELSE content END AS line FROM n)
  SELECT chunk_id, line, running::BIGINT AS running FROM (SELECT *, sum(length(line) // 4) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS running FROM l) WHERE running <= 1200""")
def chunk_budget_context_found(spark, sf_dir):
    return context.chunk_lines(found_chunks(spark, sf_dir), 1200).select("chunk_id", "line", "running")


# --- the same operators where their rules bite

MONTHS_ODD = "CASE o_orderkey % 5 WHEN 0 THEN ' ' || d || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN substr(d, 1, 4) || '-13' ELSE d END"


@query(f"""WITH m AS (SELECT o_orderkey, {MONTHS_ODD} AS x FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS d FROM orders)), p AS (SELECT *, CASE WHEN regexp_matches(trim(x), '^[0-9]{{4}}-(0[1-9]|1[0-2])$') THEN trim(x) END AS month FROM m)
  SELECT o_orderkey, month, (substr(month, 1, 4)::INT * 12 + substr(month, 6, 2)::INT)::INT AS month_idx, CASE WHEN month IS NOT NULL THEN 'month' END AS granularity, coalesce(nullif(x, ''), 'TIME_UNKNOWN') AS suffix FROM p""")
def month_stamps(spark, sf_dir):
    d, r = timefn.month_of(F.col("o_orderdate")), F.col("o_orderkey") % 5
    odd = F.when(r == 0, F.concat(F.lit(" "), d, F.lit(" "))).when(r == 1, F.lit("")).when(r == 2, F.lit(None)).when(r == 3, F.concat(F.substring(d, 1, 4), F.lit("-13"))).otherwise(d)
    s = timefn.stamped(t(spark, sf_dir, "orders").select("o_orderkey", odd.alias("date")))
    return s.select("o_orderkey", "month", "month_idx", "granularity", timefn.suffix(F.col("date")).alias("suffix"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS by_month, strftime(o_orderdate, '%Y-%m') AS by_name, strftime(o_orderdate, '%Y-%m') AS by_content FROM orders")
def time_after_other_digits(spark, sf_dir):
    d, key = F.col("o_orderdate"), F.col("o_orderkey").cast("string")
    m, none = timefn.month_of(d), F.lit("")
    by_month = timefn.find_time(F.concat(F.lit("doc_1234_"), F.lpad(key, 9, "7"), F.lit("_"), m, F.lit(".txt")), none)
    by_name = timefn.find_time(F.concat(F.lit("9"), key, F.lit("4321 "), F.date_format(d, "MMM"), F.lit("  "), F.year(d), F.lit(".md")), none)
    by_content = timefn.find_time(F.lit("notes_12345.md"), F.concat(F.lit("room 0042, "), F.date_format(d, "MMMM yyyy")))
    return t(spark, sf_dir, "orders").select("o_orderkey", timefn.to_month(by_month).alias("by_month"), timefn.to_month(by_name).alias("by_name"), timefn.to_month(by_content).alias("by_content"))


@query(f"SELECT chunk_id, regexp_extract(chunk_id, '^[0-9]+') AS document, digest FROM ({WINDOWS})")
def chunk_documents(spark, sf_dir):
    c = chunking.char_windows(t(spark, sf_dir, "documents"), min_tokens=chunking.MIN)
    return c.select("chunk_id", textfn.document_of(F.col("chunk_id")).alias("document"), F.md5("content").alias("digest"))


@query(f"WITH {G} SELECT src, dst, round(time_similarity, 6) AS time_similarity FROM links WHERE time_similarity < 0.75 OR time_similarity = 1")
def temporal_links_missing(spark, sf_dir):
    n, e = _built(spark, sf_dir, False)
    one = graph.temporal_links(n, e).filter("time_similarity < 1 and time_similarity > 0.75")  # links of neighbouring months are there already
    return graph.temporal_links(n, e.unionByName(one)).select("src", "dst", F.round("time_similarity", 6).alias("time_similarity"))


@query(f"""WITH {G}, one AS (SELECT min(src) AS s FROM sem), k AS (SELECT s, min(split_part(type, ', ', 1)) AS k FROM sem JOIN one ON src = s GROUP BY s)
  SELECT node_id, nodes.type AS type, sem.type AS keywords FROM k JOIN sem ON src = s AND list_contains(string_split(sem.type, ', '), k) JOIN nodes ON node_id = dst""")
def neighbors_of_first_node(spark, sf_dir):
    n, e = _built(spark, sf_dir)
    one = e.filter("not is_temporal").groupBy("src").agg(F.min(F.element_at("relation_keywords", 1)).alias("k")).orderBy("src").first()
    return graph.neighbors(n, e, one.src, [one.k]).select("node_id", "type", F.array_join("relation_keywords", ", ").alias("keywords"))


@query(f"WITH {G}, {REL_SQL} SELECT src, dst, type, round(score, 6) AS score, place FROM r1")
def relation_search_among_links(spark, sf_dir):
    n, e = _built(spark, sf_dir)
    out = retrieve.relation_search(with_vectors(e, spark, sf_dir, 7), query_vector(spark, sf_dir), PARAMS)
    return out.select("src", "dst", "type", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {G}, n2 AS (SELECT CASE WHEN first_ord % 11 = 0 THEN NULL ELSE name END AS name, node_id, CASE WHEN first_ord % 7 = 0 THEN NULL ELSE month_idx END AS mi FROM nodes WHERE name <> 'BUILDING'),
  e2 AS (SELECT src, CASE WHEN first_ord % 13 = 0 THEN src ELSE dst END AS dst FROM sem WHERE date <> '1996-03'), used AS (SELECT src AS s FROM e2 UNION SELECT dst FROM e2)
  SELECT 'missing_attribute' AS rule, 'issue' AS severity, node_id AS subject FROM n2 WHERE name IS NULL UNION ALL SELECT 'no_time', 'warning', node_id FROM n2 WHERE mi IS NULL
  UNION ALL SELECT 'isolated', 'warning', node_id FROM n2 WHERE node_id NOT IN (SELECT s FROM used) UNION ALL SELECT 'self_loop', 'warning', src FROM e2 WHERE src = dst
  UNION ALL SELECT 'missing_node', 'issue', s FROM used WHERE s NOT IN (SELECT node_id FROM n2)""")
def graph_validate_every_rule(spark, sf_dir):
    n, e = _built(spark, sf_dir, False)  # damaged so that every rule is broken
    n = n.filter("name <> 'BUILDING'").withColumns({"name": F.expr("if(first_ord % 11 = 0, null, name)"), "month_idx": F.expr("if(first_ord % 7 = 0, null, month_idx)")})
    e = e.filter("date <> '1996-03'").withColumn("dst", F.expr("if(first_ord % 13 = 0, src, dst)"))
    return graph.validation(n, e)


@query(f"""WITH {G}, x AS (SELECT n.date AS date, bool_or(is_temporal) AS tmp FROM edges JOIN nodes n ON n.node_id = dst GROUP BY src, dst, n.date)
  SELECT 'strict' AS mode, 'cross_time' AS scope, count(*) AS n FROM x WHERE date IN ({", ".join(f"'{m}'" for m in MONTHS)})
  UNION ALL SELECT 'expanded', 'cross_time', count(*) FROM x WHERE date IN ({", ".join(f"'{m}'" for m in timefn.expand(MONTHS, "adjacent"))})
  UNION ALL SELECT 'with_temporal', 'cross_time', count(*) FROM x WHERE tmp OR date IN ({", ".join(f"'{m}'" for m in MONTHS)})
  UNION ALL SELECT 'with_temporal', 'within_range', count(*) FROM x WHERE date IN ({", ".join(f"'{m}'" for m in MONTHS)})""")
def neighbor_time_filter(spark, sf_dir):
    n, e = _built(spark, sf_dir)
    x = e.select("src", F.col("dst").alias("node_id"), "is_temporal").join(n.select("node_id", "date"), "node_id").groupBy("src", "node_id", "date").agg(F.bool_or("is_temporal").alias("tmp"))
    cases = [("strict", "cross_time"), ("expanded", "cross_time"), ("with_temporal", "cross_time"), ("with_temporal", "within_range")]
    counts = x.agg(*[F.count_if(filters.neighbor_in(F.col("date"), F.col("tmp"), MONTHS, m, s)).alias(f"c{i}") for i, (m, s) in enumerate(cases)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(s).alias("scope"), F.col(f"c{i}").alias("n")) for i, (m, s) in enumerate(cases)])))


@query(f"WITH {G}, {REL_SQL} SELECT src, dst, type, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM r1) THEN 0 ELSE 1 END AS src_ord FROM sem")
def relations_keep_first(spark, sf_dir):
    n, e = _built(spark, sf_dir, False)
    v = with_vectors(e, spark, sf_dir, 7)
    found = retrieve.relation_search(v, query_vector(spark, sf_dir), PARAMS)
    rest = e.select("src", "dst", F.array_join("relation_keywords", ", ").alias("type"), F.lit(1.0).alias("score"), F.lit(1).alias("src_ord"), F.lit(0).alias("place"))
    return retrieve.merged_relations(found, rest).select("src", "dst", "type", "src_ord")


@query(f"""WITH {G}, x AS (SELECT ev.src, ev.dst, date, (list_cosine_similarity(ev.v, a.v) + list_cosine_similarity(ev.v, b.v)) / 2 AS sem FROM ev JOIN (SELECT node_id, v FROM nv) a ON a.node_id = src JOIN (SELECT node_id, v FROM nv) b ON b.node_id = dst)
  SELECT src, dst, round(sem, 6) AS semantic, round(least(1.0, (0.7 * (0.6 * sem + 0.4 * {rel(MI)}) + 0.15) * 0.7), 6) AS score FROM x""")
def edge_scores(spark, sf_dir):
    n, e = _vector_graph(spark, sf_dir)
    ends = n.select("node_id", F.col("embedding").alias("v"))
    x = e.join(ends.select(F.col("node_id").alias("src"), F.col("v").alias("a")), "src").join(ends.select(F.col("node_id").alias("dst"), F.col("v").alias("b")), "dst")
    sem = scoring.edge_semantic(vectorfn.cosine(F.col("embedding"), F.col("a")), vectorfn.cosine(F.col("embedding"), F.col("b")), F.col("description"))
    x = x.select("src", "dst", "date", sem.alias("sem"))
    return x.select("src", "dst", F.round("sem", 6).alias("semantic"), F.round(scoring.edge(F.col("sem"), scoring.relevance(F.col("date"), MONTHS), F.lit(0.0), 1), 6).alias("score"))


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]) * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS total FROM embeddings")
def vector_upsert(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").withColumn("version", F.lit(0))
    newer = v.filter("vec_id % 3 = 0").withColumns({"embedding": F.transform("embedding", lambda x: (x * 2).cast("float")), "version": F.lit(1)})
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return knn.checked(knn.latest(v.unionByName(newer), "vec_id", "version"), 64).select("vec_id", "label", F.round(total, 6).alias("total"))


@query(f"""WITH {G}, a AS (SELECT sum(length('- **' || name || '** (' || type || ') [' || date || ']: ' || description) // 4) AS n FROM nodes),
  b AS (SELECT sum(length('- **' || split_part(src, '__', 1) || '** ' || type || ' **' || split_part(dst, '__', 1) || '** [' || date || ']: ' || description) // 4) AS n FROM sem), c AS (SELECT sum(length(text) // 4) AS n FROM documents)
  SELECT a.n::BIGINT AS entities, b.n::BIGINT AS relations, c.n::BIGINT AS chunks, (a.n + b.n + c.n + 100)::BIGINT AS total FROM a, b, c""")
def context_estimate(spark, sf_dir):
    n, e = _built(spark, sf_dir, False)
    x = context.estimate(n.withColumn("score", F.lit(1.0)), _rel_named(e), dated_chunks(spark, sf_dir), 100)
    return x.select(*[F.col(c).cast("long").alias(c) for c in ("entities", "relations", "chunks", "total")])


def document_files(spark, sf_dir):
    """All documents as files of three formats, a fourth that isn't supported, and broken JSON among them."""
    k = F.col("doc_id") % 5
    kind = F.when(k == 0, "txt").when(k == 1, "MD").when(k == 4, "xyz").otherwise("json")
    body = F.when(k == 2, F.to_json(F.struct(F.col("text").alias("content")))).when(k == 3, F.concat(F.lit("{broken"), "text")).otherwise(F.concat(F.lit("\ufeff"), "text"))
    path = F.concat(F.lit("/in/rep_"), F.col("doc_id").cast("string"), F.lit("_2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("."), kind)
    d = t(spark, sf_dir, "documents").select(path.alias("path"), body.cast("binary").alias("content"))
    return files.supported(d.withColumn("length", F.octet_length("content").cast("long")))


FILES = """f AS (SELECT 'rep_' || doc_id || '_2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS doc_id, '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS date, CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'json' END AS file_format,
  CASE WHEN doc_id % 5 <> 3 THEN text END AS text, CASE WHEN doc_id % 5 = 3 THEN 'not JSON' WHEN trim(text, ' ') = '' THEN 'empty file' END AS error FROM documents WHERE doc_id % 5 <> 4)"""


@query(f"WITH {FILES} SELECT doc_id, date, file_format, md5(text) AS digest, length(text)::INT AS characters, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS lines, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))::INT AS words, error FROM f")
def files_to_documents(spark, sf_dir):
    return files.documents(document_files(spark, sf_dir)).select("doc_id", "date", "file_format", F.md5("text").alias("digest"), "characters", "lines", "words", "error")


@query(f"WITH {FILES} SELECT count(*) AS files, count(*) FILTER (error IS NULL) AS read, count(*) FILTER (error IS NOT NULL) AS failed, count(DISTINCT date) FILTER (error IS NULL) AS dates, string_agg(DISTINCT file_format, ',' ORDER BY file_format) FILTER (error IS NULL) AS formats FROM f")
def file_ingest_stats(spark, sf_dir):
    s = files.ingest_stats(files.documents(document_files(spark, sf_dir)))
    return s.select("files", "read", "failed", "dates", F.array_join("formats", ",").alias("formats"))


# --- the engine: every chunk of the documents mentions an entity that is named by its length


def _length_model(system: str, text: str) -> str:
    return json.dumps({"entities": [{"entity_name": f"LEN{len(text) % 50}", "entity_type": "PRODUCT", "entity_description": ""}], "relationships": []})


def _engine(spark):
    return Engine(spark, model=_length_model, chunks=ChunkParams(sentence_boundary=False), ranks=CentralityParams(10, 10, 10))


def _dated_documents(spark, sf_dir):
    month = F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))
    return t(spark, sf_dir, "documents").select("doc_id", "text", month.alias("date"), F.col("doc_id").alias("doc_ord"))


CHUNKED = f"""c AS (SELECT chunk_id, doc_id, length(x) AS n FROM (SELECT doc_id || '_chunk_' || i AS chunk_id, doc_id, substring(c, (i * 1800 + 1)::BIGINT, 2000) AS x FROM (SELECT doc_id, c, unnest(range(0, greatest(1, ceil((length(c) - 2000) / 1800.0)::BIGINT + 1))) AS i FROM (SELECT doc_id, {CLEAN} AS c FROM documents) WHERE c <> '')) WHERE length(x) // 4 >= 100)"""
LENGTHS = f"{CHUNKED}, n AS (SELECT 'LEN' || n % 50 || '__2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS node_id, count(DISTINCT doc_id) AS docs FROM c GROUP BY 1)"


@query(f"WITH {CHUNKED} SELECT chunk_id, n::INT AS characters FROM c")
def engine_reinsert(spark, sf_dir):
    e, docs = _engine(spark), _dated_documents(spark, sf_dir)
    e.insert(docs.withColumn("text", F.concat(F.lit("Older. "), "text")))
    e.insert(docs)
    return e.tables["chunks"].select("chunk_id", F.length("content").alias("characters"))


@query(f"WITH {LENGTHS} SELECT node_id, docs FROM n")
def engine_reload_insert(spark, sf_dir):
    docs, path = _dated_documents(spark, sf_dir), f"{centrality.checkpoint_dir(spark)}/engine-{uuid.uuid4().hex}"
    one = _engine(spark)
    one.insert(docs.filter("doc_id % 2 = 0"))  # the even ids first, the odd ones after a reload, and all are built
    one.build()
    one.save(path)
    two = _engine(spark)
    two.load(path)
    two.insert(docs.filter("doc_id % 2 <> 0"))
    two.build()
    two.save(path)
    return two.tables["nodes"].select("node_id", F.size("source_doc_ids").cast("long").alias("docs"))


# --- answers of models, and JSON


@query("SELECT doc_id, 0 AS i, lang AS name, 'Other' AS type, coalesce(source, '') AS description FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, 1, source, 'COMPANY', '' FROM documents WHERE doc_id % 3 <> 2")
def extraction_json_parse(spark, sf_dir):
    raw = F.format_string('{"entities":[{"entity_name":"%s","entity_description":"%s"},{"entity_name":"%s","entity_type":"COMPANY"}]%s', "lang", "source", "source", F.when(F.col("doc_id") % 3 == 2, F.lit(",,")).otherwise(F.lit("}")))
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.lit(None).cast("string").alias("date"), F.col("doc_id").alias("doc_ord"), F.lit(0).alias("chunk_index"), raw.alias("answer"))
    m = extract.entity_mentions(d)
    return m.select(F.col("doc_ord").alias("doc_id"), F.pmod("ord", F.lit(1 << 20)).cast("int").alias("i"), "name", "type", "description")


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def json_props_parse(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query()
def mentions_by_rules(spark, sf_dir):
    chunks = chunking.char_windows(t(spark, sf_dir, "documents")).withColumns({"date": F.lit("2024-01"), "doc_ord": F.col("doc_id")})
    return extract.entity_mentions(extract.asked(chunks)).groupBy("name").agg(F.count("*").alias("n"))
