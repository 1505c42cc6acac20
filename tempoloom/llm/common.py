"""What the training-data operators share: tables, checkpoints, size-checked joins, sorted naming, components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A join side is broadcast only if it has at most so many rows (of a few longs), some 10 MB of the driver's heap, which
#: holds each twice and several at a time; beyond that the join shuffles.
BROADCAST_ROWS = 100_000
#: A key of more rows than this (or than a hundred-thousandth of all, if that is more) is salted in joins.
HEAVY_ROWS = 50_000
#: Bits of the filter of larger semi and anti joins; a power of 2, 8 MB.
FILTER_BITS = 1 << 26
#: Up to so many edges (of two longs, some 200 bytes each while they are joined), components are found on the driver.
SMALL_EDGES = 200_000
#: Python workers cut Arrow batches into slices of about so many bytes of text (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 1 << 20)  # arrays of a megabyte or more are mapped, so that they are given back when freed
except (OSError, AttributeError):  # another C library
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the session names."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it names none, local mode gets one, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def free(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Null-safe join; ``small`` (checkpointed, so counting is cheap) is broadcast only within BROADCAST_ROWS.

    Beyond, a semi or anti join shuffles only the rows of ``big`` that a bitmap of hashes of FILTER_BITS bits can't rule out."""
    name = {c: free(f"_r_{c}", big, small) for c in on}
    renamed = small.toDF(*[name.get(c, c) for c in small.columns])
    cond = None
    for c in on:
        this = F.col(f"`{c}`").eqNullSafe(F.col(f"`{name[c]}`"))
        cond = this if cond is None else cond & this
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(renamed), cond, how).drop(*name.values())
    if how not in ("left_semi", "left_anti") or any(big.schema[c].dataType != small.schema[c].dataType for c in on):
        return big.join(renamed, cond, how).drop(*name.values())
    known, flag = _sieved(big, renamed, on, list(name.values()))
    own = [f"`{c}`" for c in big.columns]
    some = known.filter(F.col(flag)).select(*own).join(renamed, cond, how)
    return some if how == "left_semi" else known.filter(~F.col(flag)).select(*own).union(some)


def _sieved(big: DataFrame, small: DataFrame, on: list[str], names: list[str]) -> tuple[DataFrame, str]:
    """big with a column, and its name, that is false only where no row of small has the keys ``on``, there called names."""
    at, flag = free("_bucket_", big), free("_bits_", big)
    place = lambda keys: F.pmod(F.xxhash64(*[f"`{c}`" for c in keys]), F.lit(FILTER_BITS)) + 1
    have = checkpoint(small.select(place(names).alias("h")).groupBy(F.bitmap_bucket_number("h").alias(at)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias(flag)))
    bit = F.bitmap_bit_position(place(on))
    byte = F.conv(F.hex(F.substring(F.col(flag), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = big.withColumn(at, F.bitmap_bucket_number(place(on))).join(F.broadcast(have), at, "left")
    return known.withColumn(flag, F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))).drop(at), flag


def sieve(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The rows that may have a match in the table (of the same key types), and few others: what an inner join has to shuffle."""
    known, flag = _sieved(rows, table, on, on)
    return known.filter(F.col(flag)).select(*[f"`{c}`" for c in rows.columns])


def heavy_keys(sizes: DataFrame, on: list[str]) -> DataFrame | None:
    """(on, _salts) of the keys of more than HEAVY_ROWS rows, the BROADCAST_ROWS largest at most; None if there are none.

    sizes: on, n (rows of each key). Lesser keys than those would be of less than a hundred-thousandth of all rows each.
    """
    salts = F.ceil(F.col("n") / HEAVY_ROWS).cast("int").alias("_salts")
    rows = sizes.filter(F.col("n") > HEAVY_ROWS).orderBy(F.desc("n"), *on).limit(BROADCAST_ROWS).select(*on, salts).toArrow()
    return sizes.sparkSession.createDataFrame(rows) if rows.num_rows else None


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], heavy: DataFrame | None) -> DataFrame:
    """Inner join of rows to a table; the rows of a heavy key are cut by the hash of the columns ``by``, and the table's repeated."""
    if heavy is None:
        return rows.join(table, on)
    many = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), many).cast("int")).drop("_salts")
    right = table.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def sized_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], count: str = "n") -> DataFrame:
    """Inner join to a checkpointed table whose column ``count`` says how many rows each of its keys has; the column goes.

    The table is broadcast within BROADCAST_ROWS; beyond, the join shuffles the rows that a bitmap of its keys leaves, and heavy keys are salted."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(count)), on)
    return salted_join(sieve(rows, table, on), table.drop(count), on, by, heavy_keys(table.select(*on, F.col(count).alias("n")), on))


def slices(nbytes: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes each."""
    first, total = 0, 0
    for i, n in enumerate(nbytes.tolist()):
        if total and total + n > size:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(nbytes):
        yield first, len(nbytes)


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Pieces of an Arrow batch with their texts as large strings, nulls as empty ones."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), size):
        yield batch.slice(a, b - a), texts.slice(a, b - a)
    del texts
    release()


def release() -> None:
    """Give what a batch needed back to the system, as Python workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _named(rows: DataFrame, keys: list[str], carry: list[str], hot: bool = False) -> DataFrame:
    """carry and ``_name``: (bucket << 40) + rank among the bucket's sorted keys. Buckets are by hash, so they hold whole keys."""
    buckets = min(8 * partitions(rows.sparkSession), 1 << 20)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    ranked = rows.withColumn("_b", bucket).withColumn("_rank", F.dense_rank().over(Window.partitionBy("_b").orderBy(*keys)))
    return ranked.select(*carry, (F.shiftleft(F.col("_b") + (buckets if hot else 0), 40) + F.col("_rank")).alias("_name"))


def name_sorted(df: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """carry and ``_name``, an integer name that rows share if and only if their keys (never null) are equal; checkpointed.

    Keys are sorted in buckets of whole keys. A key of more than HEAVY_ROWS rows, found by counting hashes, goes to no
    single task: its distinct values alone are sorted, and its rows get the names by a salted join that compares contents.
    """
    rows = df.select(*keys, *carry, F.xxhash64(*keys).alias("_h"))
    heavy = heavy_keys(rows.groupBy("_h").agg(F.count("*").alias("n")), ["_h"])
    if heavy is None:
        return checkpoint(_named(rows, keys, carry))
    few = F.broadcast(heavy)
    light = _named(rows.join(few, "_h", "left_anti"), keys, carry)
    hot = rows.join(few, "_h").withColumn("_salt", F.pmod(F.xxhash64(*carry), F.col("_salts")).cast("int"))
    names = checkpoint(_named(hot.select("_h", *keys).distinct(), keys, ["_h", *keys], hot=True))
    copies = names.join(few, "_h").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_h", "_salts")
    return checkpoint(light.unionByName(hot.drop("_h", "_salts").join(copies, [*keys, "_salt"]).select(*carry, "_name")))


def _components_here(edges: DataFrame) -> DataFrame:
    got = edges.select("a", "b").toArrow()
    ids, at = np.unique(np.concatenate([got.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    x, y, low = at[: got.num_rows], at[got.num_rows :], np.arange(len(ids))
    while True:
        new, m = low.copy(), np.minimum(low[x], low[y])
        for i in (x, y, low[x], low[y]):
            np.minimum.at(new, i, m)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    kind = got.schema.field("a").type
    table = pa.table({"id": pa.array(ids, kind), "comp": pa.array(ids[low], kind)})
    return checkpoint(edges.sparkSession.createDataFrame(table, edges.select(F.col("a").alias("id"), F.col("a").alias("comp")).schema))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, comp)``, comp the least id of its component.

    Up to SMALL_EDGES edges are joined on the driver; beyond, large-star and small-star steps alternate, each checkpointed
    and hubs salted, till the edge set stands still.
    """
    if edges.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        return _components_here(edges)

    def lows(e: DataFrame) -> DataFrame:
        return checkpoint(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e, before = checkpoint(e), None
    while True:
        both = e.union(e.select("v", "u"))
        low = lows(both)
        near = salted_join(both, low.select("u", F.least("u", "m").alias("m")), ["u"], ["v"], heavy_keys(low, ["u"]))
        large = checkpoint(near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = lows(large)
        near = salted_join(large, low.select("u", "m"), ["u"], ["v"], heavy_keys(low, ["u"]))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = checkpoint(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id").union(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def merged_components(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp(id, comp)`` after more edges(a, b), checkpointed. Only the components that these join are searched, not all ids again."""
    ends = edges
    for c in ("a", "b"):
        ends = ends.join(comp.select(F.col("id").alias(c), F.col("comp").alias(f"_{c}")), c, "left")
    ends = ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b").distinct()
    top = checkpoint(components(checkpoint(ends)))
    moved = comp.join(top.toDF("comp", "_top"), "comp", "left").select("id", F.coalesce("_top", "comp").alias("comp"))
    return checkpoint(moved.union(top.join(comp.select("id"), "id", "left_anti").select("id", "comp")))


def hash_sample(df: DataFrame, n: int, total: int) -> DataFrame:
    """About n (at most) of total rows, by hash of doc_id; the same rows on every run."""
    share = min(1.0, 1.2 * n / max(total, 1))
    return df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("doc_id"), *df.columns).limit(n)
