"""Workspaces: Parquet tables with a manifest, and exports of a graph as JSON, GraphML and GEXF."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "chunks", "entity_mentions", "relation_mentions", "nodes", "edges", "node_centrality", "edge_centrality")


def save(path: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """Writes the tables to a folder of their own and then a line of the manifest, so that a save onto the path that they were
    loaded from, or one that breaks off, leaves what was there readable; gives the paths. Older versions stay till prune()."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    paths = {name: f"{path}/{version}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    for df in list(tables.values())[:1]:
        df.sparkSession.createDataFrame([(json.dumps({"version": version, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")
    return paths


def _versions(spark: SparkSession, path: str) -> list[dict]:
    return sorted((json.loads(r[0]) for r in spark.read.text(f"{path}/manifest").collect()), key=lambda v: v["version"])  # a line for each save


def load(spark: SparkSession, path: str, required: tuple[str, ...] = ("nodes", "edges")) -> tuple[dict[str, DataFrame], dict[str, bool]]:
    """(tables, which there are) of the last save; nodes and edges are required."""
    last = _versions(spark, path)[-1]
    there = set(last["tables"])
    if missing := set(required) - there:
        raise FileNotFoundError(f"no table {', '.join(sorted(missing))} in {path}")
    return {t: spark.read.parquet(f"{path}/{last['version']}/{t}") for t in sorted(there)}, {t: t in there for t in TABLES}


def prune(spark: SparkSession, path: str) -> int:
    """Deletes all versions but the last, which no DataFrame may still read; gives how many."""
    old = _versions(spark, path)[:-1]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = [jvm.org.apache.hadoop.fs.Path(f"{path}/{v['version']}") for v in old]
    return sum(bool(p.getFileSystem(conf).delete(p, True)) for p in folders)


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Lines of JSON, nodes and links apart, each with a kind."""
    rows = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value")).union(edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), *edges.columns)).alias("value")))
    rows.write.mode("overwrite").text(path)


def import_json(spark: SparkSession, path: str, nodes_schema, edges_schema) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.text(path)
    of = lambda kind, schema: raw.filter(F.get_json_object("value", "$.kind") == kind).select(F.from_json("value", schema).alias("r")).select("r.*")
    return of("node", nodes_schema), of("link", edges_schema)


def import_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A single node-link JSON document: objects in nodes (with id) and links (with source, target)."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.inline("nodes")), raw.select(F.inline("links"))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def _xml(head: list[str], nodes: DataFrame, middle: list[str], edges: DataFrame, tail: list[str], path: str) -> None:
    spark = nodes.sparkSession
    part = lambda k, lines: spark.createDataFrame([(k, f"{i:09d}", x) for i, x in enumerate(lines)], "k int, o string, value string")
    rows = part(0, head).union(nodes.select(F.lit(1), "o", "value")).union(part(2, middle)).union(edges.select(F.lit(3), "o", "value")).union(part(4, tail))
    rows.repartitionByRange(1, "k", "o").sortWithinPartitions("k", "o").select("value").write.mode("overwrite").text(path)


def export_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    path = path if path.endswith(".graphml") else f"{path}.graphml"
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), _escaped(F.col(c)), F.lit("</data>"))
    n = nodes.select(F.col("node_id").alias("o"), F.concat(F.lit('<node id="'), _escaped(F.col("node_id")), F.lit('">'), data("name", "name"), data("type", "type"), data("date", "date"), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat_ws("\t", "src", "dst", "key").alias("o"), F.concat(F.lit('<edge source="'), _escaped(F.col("src")), F.lit('" target="'), _escaped(F.col("dst")), F.lit('">'), data("key", "key"), data("description", "description"), F.lit("</edge>")).alias("value"))
    keys = [f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for k, f in (("name", "node"), ("type", "node"), ("date", "node"), ("key", "edge"), ("description", "edge"))]
    _xml(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">'], n, [], e, ["</graph>", "</graphml>"], path)
    return path


def export_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    path = path if path.endswith(".gexf") else f"{path}.gexf"
    n = nodes.select(F.col("node_id").alias("o"), F.concat(F.lit('<node id="'), _escaped(F.col("node_id")), F.lit('" label="'), _escaped(F.col("name")), F.lit('"/>')).alias("value"))
    e = edges.select(F.concat_ws("\t", "src", "dst", "key").alias("o"), F.concat(F.lit('<edge id="'), _escaped(F.concat_ws("|", "src", "dst", "key")), F.lit('" source="'), _escaped(F.col("src")), F.lit('" target="'), _escaped(F.col("dst")), F.lit('" type="directed"/>')).alias("value"))
    _xml(['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="directed">', "<nodes>"], n, ["</nodes>", "<edges>"], e, ["</edges>", "</graph>", "</gexf>"], path)
    return path
