"""Degree, PageRank and betweenness of a directed graph, and their combination."""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The adjacency is broadcast up to so many distinct edges; beyond, paths are followed level by level with joins.
BROADCAST_EDGES = 1_000_000
WEIGHTS = (0.3, 0.4, 0.3)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """Local mode gets a folder where the session names none, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(in + out, parallel edges counted) / (n - 1); 1 for a single node, as usual."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("d"))
    n = nodes.agg(F.count("*").alias("n"))
    joined = nodes.select("node_id").join(ends, "node_id", "left").crossJoin(F.broadcast(n))
    return joined.select("node_id", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """Power iteration; parallel edges weigh more, nodes without out-edges share their rank with all. Checkpointed every few rounds."""
    n = nodes.count()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("pagerank"))
    w = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = w.groupBy("src").agg(F.sum("w").alias("t"))
    w = checkpoint(w.join(out, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("w")))
    ranks = checkpoint(nodes.select("node_id").join(out.select(F.col("src").alias("node_id"), F.lit(False).alias("ends")), "node_id", "left").select("node_id", F.coalesce("ends", F.lit(True)).alias("ends"), F.lit(1.0 / n).alias("r")))
    before = ranks
    for i in range(1, iterations + 1):
        sent = w.join(ranks, F.col("src") == F.col("node_id")).groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("w") * F.col("r")).alias("s"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("r"))), F.lit(0.0)).alias("lost"))
        new = F.lit((1 - damping) / n) + damping * (F.coalesce("s", F.lit(0.0)) + F.col("lost") / n)
        ranks = ranks.drop("r").join(sent, "node_id", "left").crossJoin(F.broadcast(lost)).select("node_id", "ends", new.alias("r"))
        if i % every == 0 or i == iterations:
            ranks = checkpoint(ranks)
            if tolerance and i < iterations:
                moved = ranks.join(before.select("node_id", F.col("r").alias("b")), "node_id").agg(F.sum(F.abs(F.col("r") - F.col("b")))).first()[0]
                if moved < n * tolerance * every:
                    break
            before = ranks
    return ranks.select("node_id", F.col("r").alias("pagerank"))


def pivots(nodes: DataFrame, k: int) -> DataFrame:
    """k nodes by hash order, the same on every run."""
    return nodes.select("node_id").orderBy(F.xxhash64("node_id"), "node_id").limit(k)


def _brandes(start: int, indptr: np.ndarray, to: np.ndarray, n: int) -> tuple[dict[int, float], dict[tuple[int, int], float]]:
    dist, paths, order, before = {start: 0}, {start: 1.0}, [], {start: []}
    queue = deque([start])
    while queue:
        v = queue.popleft()
        order.append(v)
        for x in to[indptr[v] : indptr[v + 1]].tolist():
            if x not in dist:
                dist[x], paths[x], before[x] = dist[v] + 1, 0.0, []
                queue.append(x)
            if dist[x] == dist[v] + 1:
                paths[x] += paths[v]
                before[x].append(v)
    share = dict.fromkeys(order, 0.0)
    edge: dict[tuple[int, int], float] = {}
    for x in reversed(order):
        for v in before[x]:
            c = paths[v] / paths[x] * (1 + share[x])
            edge[v, x] = c
            share[v] += c
    del share[start]
    return share, edge


def _paths_broadcast(spark: SparkSession, nodes: DataFrame, links: DataFrame, starts: DataFrame) -> DataFrame:
    ids = [r[0] for r in nodes.select("node_id").orderBy("node_id").collect()]
    number = {x: i for i, x in enumerate(ids)}
    rows = [(number[r[0]], number[r[1]]) for r in links.collect() if r[0] in number and r[1] in number]
    pairs = np.array(sorted(rows), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1)), pairs[:, 1].copy(), ids, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indptr, to, ids, number = shared.value
        for b in batches:
            for start in b.column(0).to_pylist():
                share, edge = _brandes(number[start], indptr, to, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in share] + [ids[v] for v, _ in edge], pa.string()), pa.array([None] * len(share) + [ids[x] for _, x in edge], pa.string()), pa.array([*share.values(), *edge.values()], pa.float64())], names=["src", "dst", "c"])

    return starts.repartition(min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, "src string, dst string, c double")


def _paths_joined(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The same by joins: all pivots' searches move on one level at a time, then contributions flow back."""
    seen = checkpoint(starts.select(F.col("node_id").alias("p"), F.col("node_id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    front, depth, steps = seen, 0, []
    while True:
        step = front.join(links, F.col("v") == F.col("src")).select("p", F.col("v").alias("a"), F.col("dst").alias("v"), "paths")
        step = checkpoint(step.join(seen.select("p", "v"), ["p", "v"], "left_anti"))
        if not step.limit(1).count():
            break
        depth += 1
        steps.append(step)
        front = checkpoint(step.groupBy("p", "v").agg(F.lit(depth).alias("d"), F.sum("paths").alias("paths")))
        seen = checkpoint(seen.unionByName(front))
    share, edges = None, []
    for step in reversed(steps):
        x = step.join(seen.select("p", "v", F.col("paths").alias("all")), ["p", "v"])
        if share is not None:
            x = x.join(share, ["p", "v"], "left")
        one = checkpoint(x.select("p", "a", "v", (F.col("paths") / F.col("all") * (1 + (F.coalesce("s", F.lit(0.0)) if share is not None else F.lit(0.0)))).alias("c")))
        edges.append(one)
        share = checkpoint(one.groupBy("p", F.col("a").alias("v")).agg(F.sum("c").alias("s")))
    if not edges:
        return starts.select(F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("c")).limit(0)
    every = edges[0]
    for e in edges[1:]:
        every = every.union(e)
    return every.select(F.col("a").alias("src"), F.col("v").alias("dst"), "c").union(every.filter("a <> p").select(F.col("a").alias("src"), F.lit(None).cast("string"), "c"))


def betweenness(nodes: DataFrame, edges: DataFrame, node_pivots: int = 100) -> tuple[DataFrame, DataFrame]:
    """(node_id, betweenness) and (src, dst, betweenness) from pivots by Brandes' sums, normalised and scaled to all sources."""
    spark, n = nodes.sparkSession, nodes.count()
    links = checkpoint(edges.filter("src <> dst").select("src", "dst").distinct())
    k = max(1, min(node_pivots, n))
    starts = checkpoint(pivots(nodes, k))
    small = links.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES and n <= BROADCAST_EDGES
    got = checkpoint(_paths_broadcast(spark, nodes, links, starts) if small else _paths_joined(links, starts))
    sums = got.groupBy("src", "dst").agg(F.sum("c").alias("c"))
    of_node = sums.filter("dst is null").select(F.col("src").alias("node_id"), (F.col("c") * (n / k / max((n - 1) * (n - 2), 1))).alias("betweenness"))
    of_node = nodes.select("node_id").join(of_node, "node_id", "left").select("node_id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
    of_edge = sums.filter("dst is not null").select("src", "dst", (F.col("c") * (n / k / max(n * (n - 1), 1))).alias("betweenness"))
    return of_node, links.join(of_edge, ["src", "dst"], "left").select("src", "dst", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def combined(nodes: DataFrame, edges: DataFrame, node_pivots: int = 100, edge_pivots: int = 50, iterations: int = 50) -> tuple[DataFrame, DataFrame]:
    """(node_id, degree, betweenness, pagerank, centrality) and (src, dst, betweenness), to be kept as tables."""
    a, b, c = WEIGHTS
    of_node, of_edge = betweenness(nodes, edges, node_pivots)
    if edge_pivots != node_pivots:
        of_edge = betweenness(nodes, edges, edge_pivots)[1]
    out = degree(nodes, edges).join(of_node, "node_id").join(pagerank(nodes, edges, iterations=iterations), "node_id")
    return out.withColumn("centrality", a * F.col("degree") + b * F.col("betweenness") + c * F.col("pagerank")), of_edge


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the least id of each weakly connected part, by label propagation with pointer jumping."""
    both = checkpoint(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = checkpoint(nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        near = both.join(label, F.col("dst") == F.col("node_id")).groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("m"))
        new = label.join(near, "node_id", "left").select("node_id", F.least("component", "m").alias("c"))
        jump = new.select(F.col("node_id").alias("c"), F.col("c").alias("j"))
        new = checkpoint(new.join(jump, "c", "left").select("node_id", F.least("c", "j").alias("component")))
        if not new.join(label, ["node_id", "component"], "left_anti").limit(1).count():
            return new
        label = new


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(components, is_connected) in the weak sense; an empty graph isn't connected."""
    return components(nodes, edges).agg(F.count_distinct("component").alias("components")).withColumn("is_connected", F.col("components") == 1)
