"""Directories and files to documents. A file that can't be read is a row with an error, never a failed job."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoloom.functions.timefn import find_time, to_month

SUPPORTED = ("txt", "md", "json", "pdf", "docx")


def scan(spark: SparkSession, path: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, file_size, content, file_format of the supported files. Spark lists no files of zero bytes; a missing path is its error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return supported(raw)


def supported(raw: DataFrame) -> DataFrame:
    """raw: path, length, content."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return raw.select("path", F.col("length").alias("file_size"), "content", kind.alias("file_format")).filter(F.col("file_format").isin(*SUPPORTED))


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processor file, from its XML."""
    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8")
    out = []
    for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        out.append(unescape("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))))
    return "\n".join(out)


def no_pdf(data: bytes) -> str:
    raise ValueError("no PDF reader is given")


def _reader(read: Callable[[bytes], str]):
    @F.pandas_udf("struct<text:string,error:string>")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            try:
                rows.append((read(bytes(x)), None) if x is not None else (None, None))
            except Exception as e:  # noqa: BLE001 - kept as the row's error
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return run


def json_text(raw: Column) -> Column:
    """An object's content, text or body, else all of it; an array's items by line; a scalar as text."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    field = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("content", "text", "body")])
    items = F.try_variant_get(v, "$", "array<string>")
    return F.when(kind.startswith("OBJECT"), F.coalesce(field, raw)).when(kind.startswith("ARRAY"), F.array_join(items, "\n")).otherwise(F.try_variant_get(v, "$", "string"))


def plain_text(content: Column) -> Column:
    """UTF-8 without a byte order mark if it is, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^﻿", "")


def documents(files: DataFrame, pdf: Callable[[bytes], str] = no_pdf, docx: Callable[[bytes], str] = docx_text) -> DataFrame:
    """doc_id, path, text, date, file_size, file_format, lines, characters, words, error."""
    raw = plain_text(F.col("content"))
    by = lambda *k: F.col("file_format").isin(*k)
    text = files.filter(by("txt", "md")).withColumn("text", raw).withColumn("error", F.lit(None).cast("string"))
    json = files.filter(by("json")).withColumn("text", json_text(raw)).withColumn("error", F.when(F.try_parse_json(raw).isNull(), F.lit("not JSON")))
    out = text.unionByName(json)
    for kind, read in (("pdf", pdf), ("docx", docx)):
        out = out.unionByName(files.filter(by(kind)).withColumn("r", _reader(read)(F.col("content"))).withColumns({"text": F.col("r.text"), "error": F.col("r.error")}).drop("r"))
    out = out.withColumn("error", F.coalesce("error", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("empty file"))))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    found = find_time(F.regexp_extract("path", r"([^/]+)$", 1), F.col("text"))
    out = out.withColumns({"stem": stem, "time_found": found}).withColumn("date", to_month(F.col("time_found")))
    twice = out.groupBy("stem").agg(F.count("*").alias("_n"))
    out = out.join(twice, "stem").withColumn("doc_id", F.when(F.col("_n") > 1, F.concat_ws("_", "stem", F.substring(F.sha2("path", 256), 1, 8))).otherwise(F.col("stem")))
    return out.select(
        "doc_id", "path", "text", "date", "time_found", "file_size", "file_format",
        F.size(F.split("text", "\n")).alias("lines"), F.length("text").alias("characters"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"), "error",
    )


def write_log(documents: DataFrame, path: str, seconds: float = 0.0) -> None:
    """Appends what was read, and what wasn't, to the ingest log; seconds is what the run took and is shared among its files."""
    rows = documents.select("path", "doc_id", "file_size", "file_format", "date", "error")
    n = max(rows.count(), 1)
    rows.withColumns({"seconds": F.lit(seconds / n), "logged_at": F.current_timestamp()}).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The last entry of each file, or None where there is no log yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    log = spark.read.parquet(path)
    last = F.max_by(F.struct(*[c for c in log.columns if c != "path"]), F.col("logged_at"))
    return log.groupBy("path").agg(last.alias("r")).select("path", "r.*")


def unread(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files that the log has not, by path and size: where an interrupted run goes on."""
    return files.join(log.filter("error is null").select("path", "file_size"), ["path", "file_size"], "left_anti")


def ingest_stats(log: DataFrame) -> DataFrame:
    """Totals of a log, or of documents, which have no seconds."""
    ok = F.col("error").isNull()
    took = F.col("seconds") if "seconds" in log.columns else F.lit(None).cast("double")
    return log.agg(
        F.count("*").alias("files"), F.count_if(ok).alias("read"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("file_size"))), F.lit(0)).alias("bytes"),
        F.avg(F.when(ok, F.col("file_size"))).alias("mean_bytes"), F.min(F.when(ok, F.col("file_size"))).alias("min_bytes"), F.max(F.when(ok, F.col("file_size"))).alias("max_bytes"),
        F.count_distinct(F.when(ok, F.col("date"))).alias("dates"), F.array_sort(F.collect_set(F.when(ok, F.col("file_format")))).alias("formats"),
        F.sum(took).alias("seconds"), F.avg(took).alias("mean_seconds"), F.min(took).alias("min_seconds"), F.max(took).alias("max_seconds"),
    )
