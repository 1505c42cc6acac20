"""Nearest vectors: exact, and by inverted lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoloom.functions import vectorfn as V
from tempoloom.operators.filters import equal_to


#: About so many rows are compared with so many at once.
BLOCK = 8192


def checked(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows with a vector of the right length; a wrong length fails the query."""
    ok = F.assert_true(F.size(column) == dim, F.lit("a vector has another dimension"))
    return vectors.filter(F.col(column).isNotNull()).filter(ok.isNull())


def search(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: dict[str, object] | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest rows that meet the filter, which is applied first; ties by key. One pass and a top-k, no shuffle of vectors."""
    scored = vectors.filter(equal_to(where)).filter(F.col(column).isNotNull()).withColumn("score", V.score(metric, F.col(column), V.literal(query)))
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    return scored.drop(column).orderBy(order, key).limit(k)


def latest(vectors: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: the last row of each key."""
    return vectors.groupBy(key).agg(F.max_by(F.struct(*[c for c in vectors.columns if c != key]), F.col(order)).alias("r")).select(key, "r.*")


def stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.agg(F.count(column).alias("total_vectors"), F.coalesce(F.max(F.size(column)), F.lit(0)).alias("dimension"), F.coalesce(F.sum(F.size(column) * 4) / 1048576, F.lit(0.0)).alias("memory_mb"))


def inverted_lists(vectors: DataFrame, lists: int = 100, seed: int = 1, column: str = "embedding"):
    """(vectors with cluster_id, centroids) by k-means fitted to all vectors; write partitioned by cluster_id so that probes prune."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    featured = vectors.filter(F.col(column).isNotNull()).withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    fitted = KMeans(k=max(2, min(lists, featured.count())), featuresCol="_v", predictionCol="cluster_id", seed=seed, maxIter=10).fit(featured)
    return fitted.transform(featured).drop("_v"), [list(map(float, c)) for c in fitted.clusterCenters()]


def probe(listed: DataFrame, centroids: list[list[float]], query: Sequence[float], k: int, probes: int = 1, metric: str = "squared_l2", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Search in the lists whose centroids are nearest."""
    near = sorted(range(len(centroids)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centroids[i], query)))[:probes]
    return search(listed.filter(F.col("cluster_id").isin(near)), query, k, metric, None, key, column)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def neighbors(listed: DataFrame, centroids: list[list[float]], k: int, probes: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, neighbor, score, place): for every row, the k others of least squared distance in the lists whose centroids are nearest; ties by key.

    Rows meet in blocks of queries and of a list's members, so a task's memory is bounded; candidates are merged by a shuffle.
    """
    centers, type_ = np.array(centroids), listed.schema[key].dataType.simpleString()
    dim = centers.shape[1]
    n, widest = listed.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    parts, blocks = max(1, -(-widest // BLOCK)), max(1, -(-n // BLOCK))

    def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            d = (centers**2).sum(1) - 2 * x @ centers.T
            near = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["q", "v", "near"])

    def nearest(queries: pa.Table, members: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if queries.num_rows and members.num_rows:
            x, y = _matrix(queries["v"], dim), _matrix(members["v"], dim)
            qs, ms = (np.array(t.to_pylist()) for t in (queries["q"], members["m"]))
            for a in range(0, len(x), 512):
                part = x[a : a + 512]
                d = (part**2).sum(1)[:, None] + (y**2).sum(1) - 2 * part @ y.T
                d[qs[a : a + 512, None] == ms] = np.inf
                last = np.partition(d, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
                row, col = np.nonzero((d <= last[:, None] * (1 + 1e-9) + 1e-9) & np.isfinite(d))
                score = ((part[row] - y[col]) ** 2).sum(1)
                order = np.lexsort((ms[col], score, row))
                row, col, score = row[order], col[order], score[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                found.append(pa.table({key: pa.array(qs[a + row[keep]]), "neighbor": pa.array(ms[col[keep]]), "score": score[keep]}))
        return pa.concat_tables(found) if found else pa.table({key: queries["q"].slice(0, 0), "neighbor": queries["q"].slice(0, 0), "score": pa.array([], pa.float64())})

    rows = listed.select(F.col(key).alias("q"), F.col(column).alias("v"))
    probed = rows.mapInArrow(lists_of, f"q {type_}, v {listed.schema[column].dataType.simpleString()}, near array<int>")
    asked = probed.select("q", "v", F.explode("near").alias("c"), F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("b")).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    member = listed.select(F.col(key).alias("m"), F.col(column).alias("v"), F.col("cluster_id").alias("c"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("p"))
    member = member.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    found = asked.groupBy("c", "p", "b").cogroup(member.groupBy("c", "p", "b")).applyInArrow(nearest, f"{key} {type_}, neighbor {type_}, score double")
    best = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "neighbor"))), 1, k).alias("best"))
    return best.select(key, F.posexplode("best").alias("place", "x")).select(key, "x.neighbor", "x.score", "place")


def pair_similarity(vectors: DataFrame, by: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(by, pairs, mean): number and mean cosine of all pairs within a group whose keys differ, without making the pairs.

    Twice the cosines of a group's pairs are the square of its unit vectors' sum less their own squares. Vectors that are null,
    have null elements or differ in length have no cosine: such pairs count, but aren't in the mean. Zero vectors' cosines are 0.
    """
    own = vectors.filter(F.col(by).isNotNull() & F.col(key).isNotNull()).select(F.col(by).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"), V.norm(F.col(vector)).alias("norm"))
    own = own.withColumn("dim", F.when(F.col("norm").isNotNull(), F.size("v")))
    twice = own.groupBy("g", "k").agg(F.count("*").alias("n")).filter("n > 1")
    copies = own.join(twice.select("g", "k"), ["g", "k"], "left_semi")

    def counted(df: DataFrame, keys: list[str], what: str, sign: int) -> DataFrame:
        got = df.groupBy(*keys).agg(F.count("*").alias("n")).select("g", (sign * F.col("n") * (F.col("n") - 1)).alias("v"))
        return got.select("g", *[(F.col("v") if c == what else F.lit(0)).cast("long").alias(c) for c in ("pairs", "compared")], F.lit(0.0).alias("cosines"))

    def summed(df: DataFrame, keys: list[str], sign: int) -> DataFrame:
        got = df.select(*keys, "norm", F.posexplode("v").alias("at", "x")).withColumn("x", F.col("x") / F.col("norm")).groupBy(*keys, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        return got.select("g", F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("compared"), (sign * (F.col("s") * F.col("s") - F.col("q"))).alias("cosines"))

    parts = []
    for df, keys, sign in ((own, ["g"], 1), (copies, ["g", "k"], -1)):
        there, long = df.filter("norm is not null"), df.filter("norm > 0")
        parts += [counted(df, keys, "pairs", sign), counted(there, keys, "compared", sign), counted(long, keys, "compared", -sign), counted(long, [*keys, "dim"], "compared", sign), summed(long, [*keys, "dim"], sign)]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    out = out.groupBy("g").agg(F.sum("pairs").alias("pairs"), F.sum("compared").alias("compared"), F.sum("cosines").alias("cosines")).filter("pairs > 0")
    return out.select(F.col("g").alias(by), F.expr("pairs div 2").alias("pairs"), (F.col("cosines") / F.nullif("compared", F.lit(0))).alias("mean"))
