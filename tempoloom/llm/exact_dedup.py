"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg).

Fixed-size blocks of each text are sorted into integer names; pairs of adjacent names are named again, level by level,
until each document has one name. (level, name) is its identity: two texts share it if and only if they are equal,
since names stand for contents, not for hashes.

Defined results: a null text is never a copy; empty texts are copies of each other; the row that stays of a group is
the one with the least doc_id (nulls last); repeated rows (same doc_id and text) count as copies of one row. Other
columns are passed through untouched whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoloom.llm.common import checked_join, checkpoint, free, name_sorted, sized_join

BLOCK_BYTES = 2048


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, _kmr_h, _kmr_rows, level, name), one for each doc_id and text; _kmr_rows counts repeated rows."""
    raw = F.col("text").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block_bytes))).cast("int")
    cut = lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes))
    docs = docs.select("doc_id", "text")
    base = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("_kmr_h"), "text", n.alias("n"))
    blocks = base.select("doc_id", "_kmr_h", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), cut)).alias("pos", "block"))
    key = ["doc_id", "_kmr_h", "n", "pos"]
    named = checkpoint(name_sorted(blocks, ["block"], key))
    largest = named.agg(F.max("n")).first()[0] or 1
    count = named.filter("pos = 0").groupBy("doc_id", "_kmr_h").agg(F.count("*").alias("_kmr_rows"))
    done = [named.filter("n = 1").select("doc_id", "_kmr_h", F.lit(0).alias("level"), F.col("_name").alias("name"))]
    for level in range(1, math.ceil(math.log2(largest)) + 1):
        side = lambda r: F.max(F.when(F.col("pos") % 2 == r, F.col("_name")))
        pairs = named.filter("n > 1").groupBy("doc_id", "_kmr_h", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r"))
        pairs = pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        named = checkpoint(name_sorted(pairs, ["l", "r"], key))
        done.append(named.filter("n = 1").select("doc_id", "_kmr_h", F.lit(level).alias("level"), F.col("_name").alias("name")))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out = out.groupBy("doc_id", "_kmr_h").agg(F.max("level").alias("level"), F.max("name").alias("name"))
    return out.join(count.select(F.col("doc_id").alias("_d"), F.col("_kmr_h").alias("_h"), "_kmr_rows"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_kmr_h") == F.col("_h"))).drop("_d", "_h")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, _kmr_h, keep_id, first, _kmr_rows): the groups of two or more rows; first marks the one that stays."""
    ids = checkpoint(identities(docs))
    same = ids.groupBy("level", "name").agg(F.sum("_kmr_rows").alias("size"), F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = checkpoint(same.filter("size > 1").drop("size"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return sized_join(ids, groups, ["level", "name"], ["doc_id"]).select("doc_id", "_kmr_h", "keep_id", first.alias("first"), "_kmr_rows")


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row (keep_id, doc_id) for each row that goes: a copy, and the document of its group that stays."""
    c = copies(docs)
    return c.select("keep_id", "doc_id", F.explode(F.array_repeat(F.lit(1), (F.col("_kmr_rows") - F.col("first").cast("int")).cast("int"))).alias("_kmr_x")).drop("_kmr_x")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without copies, all columns kept."""
    h = free("_kmr_h", docs)
    c = checkpoint(copies(docs.select("doc_id", "text")).withColumnRenamed("_kmr_h", h))
    keyed = docs.withColumn(h, F.xxhash64("text"))
    rest = checked_join(keyed.filter("text is not null"), c.filter("not first or _kmr_rows > 1").select("doc_id", h), ["doc_id", h], "left_anti")
    again = c.filter("first and _kmr_rows > 1").select("doc_id", h)
    once = checked_join(keyed.filter("text is not null"), again, ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h]) if again.limit(1).count() else None
    out = rest.unionByName(keyed.filter("text is null"))
    return (out.unionByName(once) if once is not None else out).drop(h)
