"""The temporal graph as two tables: nodes keyed by name and month, edges keyed by (src, dst, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempoloom.functions.timefn import month_index, similarity, suffix

TEMPORAL = "temporal_evolution"
EDGE = "src string, dst string, key string, relation_keywords array<string>, description string, evidence string, source_doc_id string, chunk_id string, date string, is_temporal boolean, category string, time_similarity double, time_1 string, time_2 string, first_ord bigint, first_doc_ord bigint"


def node_id(name: Column, date: Column) -> Column:
    return F.concat(name, F.lit("__"), suffix(date))


def _in_order(value: Column) -> Column:
    """The non-null values of a group in order of (doc_ord, ord)."""
    got = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("doc_ord", "ord", value.alias("v")))))
    return F.transform(got, lambda x: x["v"])


def _first(value: str) -> Column:
    return F.min_by(F.col(value), F.struct("doc_ord", "ord")).alias(value)


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """One node for each name and date: first type, chunk and document order, descriptions joined, documents in order."""
    m = mentions.withColumn("node_id", node_id(F.col("name"), F.col("date")))
    out = m.groupBy("node_id").agg(
        F.lit("entity").alias("node_type"), _first("name"), _first("type"),
        F.array_join(_in_order(F.col("description")), "\n---\n").alias("description"),
        F.array_distinct(_in_order(F.col("source_doc_id"))).alias("source_doc_ids"),
        F.first(suffix(F.col("date"))).alias("date"), _first("chunk_id"),
        F.min("ord").alias("first_ord"), F.min("doc_ord").alias("first_doc_ord"),
    )
    return out.withColumn("month_idx", month_index(F.col("date")))


def merge_edges(mentions: DataFrame) -> DataFrame:
    """One semantic edge for each pair of nodes: keywords in order, 'keyword: description' lines and evidence joined."""
    m = mentions.withColumns({"src": node_id(F.col("source"), F.col("date")), "dst": node_id(F.col("target"), F.col("date"))})
    line = F.concat(F.col("keywords"), F.lit(": "), F.coalesce(F.col("description"), F.lit("")))
    out = m.groupBy("src", "dst").agg(
        F.array_distinct(_in_order(F.col("keywords"))).alias("relation_keywords"),
        F.array_join(_in_order(line), "\n").alias("description"),
        F.array_join(_in_order(F.col("evidence")), "\n").alias("evidence"),
        _first("source_doc_id"), _first("chunk_id"), F.first(suffix(F.col("date"))).alias("date"),
        F.min("ord").alias("first_ord"), F.min("doc_ord").alias("first_doc_ord"),
    )
    none = lambda t: F.lit(None).cast(t)
    out = out.withColumns({"key": F.lit("relation"), "is_temporal": F.lit(False), "category": none("string"), "time_similarity": none("double"), "time_1": none("string"), "time_2": none("string")})
    return out.select(*[x.split()[0] for x in EDGE.split(", ")])


def _endpoints(mentions: DataFrame) -> DataFrame:
    return mentions.withColumns({"_src": node_id(F.col("source"), F.col("date")), "_dst": node_id(F.col("target"), F.col("date"))})


def accepted_relations(mentions: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """Mentions both of whose endpoints are nodes of the mention's month; strict: nodes that came no later."""
    m = _endpoints(mentions)
    for end in ("_src", "_dst"):
        n = nodes.select(F.col("node_id").alias("_n"), F.col("first_doc_ord").alias("_o"))
        cond = F.col(end) == F.col("_n")
        m = m.join(n, cond & (F.col("_o") <= F.col("doc_ord")) if strict else cond, "left_semi")
    return m.drop("_src", "_dst")


def rejected_relations(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    m = _endpoints(mentions)
    one, two = (nodes.select(F.col("node_id").alias(x)).distinct() for x in ("_a", "_b"))
    both = m.join(one, m["_src"] == F.col("_a"), "left").join(two, m["_dst"] == F.col("_b"), "left")
    return both.filter("_a is null or _b is null").drop("_src", "_dst", "_a", "_b")


def temporal_links(nodes: DataFrame, edges: DataFrame | None = None, max_gap: int = 3) -> DataFrame:
    """Edges from earlier to later nodes of one (lower name, type) at most max_gap months apart that have no edge yet.

    Each node is offered at its own month and the max_gap before it, so that the range join is an equi-join.
    """
    n = nodes.filter("month_idx is not null").select("node_id", F.lower("name").alias("k"), "type", "month_idx", "date", "first_ord")
    a = n.select(*[F.col(c).alias(f"a_{c}") for c in n.columns])
    b = n.select("*", F.explode(F.array(*[F.lit(g) for g in range(max_gap + 1)])).alias("gap")).withColumn("at", F.col("month_idx") - F.col("gap"))
    later = (F.col("gap") > 0) | (F.struct("a_first_ord", "a_node_id") < F.struct("first_ord", "node_id"))
    pairs = a.join(b, (F.col("a_k") == F.col("k")) & F.col("a_type").eqNullSafe(F.col("type")) & (F.col("a_month_idx") == F.col("at"))).filter(later)
    out = pairs.select(
        F.col("a_node_id").alias("src"), F.col("node_id").alias("dst"), F.concat_ws("_", F.lit(TEMPORAL), "a_node_id", "node_id").alias("key"),
        F.array(F.lit(TEMPORAL)).alias("relation_keywords"), F.format_string("%s evolves from %s to %s", "k", "a_date", "date").alias("description"),
        F.format_string("same entity, %d months apart", "gap").alias("evidence"), F.lit("system_temporal").alias("source_doc_id"),
        F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("date"), F.lit(True).alias("is_temporal"), F.lit(TEMPORAL).alias("category"),
        similarity(F.col("a_month_idx"), F.col("month_idx")).alias("time_similarity"), F.col("a_date").alias("time_1"), F.col("date").alias("time_2"),
        F.col("first_ord"), F.lit(None).cast("bigint").alias("first_doc_ord"),
    )
    return out if edges is None else out.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*out.columns)


def neighbors(nodes: DataFrame, edges: DataFrame, of: str, keywords: list[str] | None = None) -> DataFrame:
    """Out-neighbours of a node over edges with one of the keywords (over all edges without keywords)."""
    e = edges.filter(F.col("src") == of)
    if keywords is not None:
        e = e.filter(F.arrays_overlap("relation_keywords", F.array(*[F.lit(k) for k in keywords]).cast("array<string>")))
    return e.select("dst", "key", "relation_keywords").join(nodes, F.col("dst") == F.col("node_id"))


def timeline(nodes: DataFrame, name: str) -> DataFrame:
    """An entity's nodes by month, with the months since the one before."""
    from pyspark.sql.window import Window

    one = nodes.filter(F.lower("name") == name.lower())
    return one.withColumn("months_since", F.col("month_idx") - F.lag("month_idx").over(Window.partitionBy("type").orderBy("date", "node_id"))).orderBy("date", "node_id")


def counts_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def counts_by_entity_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def counts_by_keyword(edges: DataFrame) -> DataFrame:
    known = F.when(F.size("relation_keywords") > 0, F.col("relation_keywords")).otherwise(F.array(F.lit("unknown")))
    return edges.select(F.explode(known).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, temporal edges, mean degree and density, zeros for an empty graph."""
    n = nodes.agg(F.count("*").alias("num_nodes"), F.count_if(F.col("month_idx").isNotNull()).alias("dated_nodes"), F.count_if(F.col("node_type") == "entity").alias("entity_nodes"))
    m = edges.agg(F.count("*").alias("num_edges"), F.count_if("is_temporal").alias("temporal_edges"))
    ratio = lambda a, b, d: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), d)
    both = n.crossJoin(m)
    return both.withColumns({"avg_degree": ratio(2 * F.col("num_edges"), F.col("num_nodes"), 2), "density": ratio(F.col("num_edges"), F.col("num_nodes") * (F.col("num_nodes") - 1), 4)})


def validation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, severity, subject) of every broken rule."""
    row = lambda df, rule, severity, subject: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))
    out = row(nodes.filter("name is null or type is null or node_type is null"), "missing_attribute", "issue", F.col("node_id"))
    out = out.union(row(nodes.filter("month_idx is null"), "no_time", "warning", F.col("node_id")))
    used = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    out = out.union(row(nodes.join(used, "node_id", "left_anti"), "isolated", "warning", F.col("node_id")))
    out = out.union(row(edges.filter("src = dst"), "self_loop", "warning", F.col("src")))
    dangling = used.join(nodes.select("node_id"), "node_id", "left_anti")
    return out.union(row(dangling, "missing_node", "issue", F.col("node_id")))


def is_valid(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("severity") == "issue").alias("issues"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("is_valid", F.col("issues") == 0)
