"""The document manifest and landed files: reading, writing, hashing, change detection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.schemas import MANIFEST


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=MANIFEST, header=True, multiLine=True, escape='"')


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Written whole as one file beside the old one, then put in its place by one atomic rename: a reader finds the old or the new."""
    spark = manifest.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    manifest.select(*MANIFEST.names).coalesce(1).write.csv(staged, header=True, escape='"')
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(staged).getFileSystem(conf)
    part = next(s.getPath() for s in fs.listStatus(place(staged)) if s.getPath().getName().startswith("part-"))
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(part, fs.makeQualified(place(path)), options)
    fs.delete(place(staged), True)


def landed_files(spark: SparkSession, path: str, suffix: str = "*.pdf") -> DataFrame:
    """``doc_id`` (the file's stem) and ``content`` of landed files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), "content", "modificationTime")


def pdf_start(content: Column) -> Column:
    """Position (from 1) of the PDF mark within the first 4096 bytes, 0 without one."""
    return F.locate("%PDF-", F.decode(F.substring(content, 1, 4096), "ISO-8859-1"))


def clean_pdf(files: DataFrame) -> DataFrame:
    """Files with ``content`` from the PDF mark on, ``sha256`` of that, and ``error`` where there is no mark."""
    at = pdf_start(F.col("content"))
    body = F.when(at > 0, F.expr("substring(content, locate('%PDF-', decode(substring(content, 1, 4096), 'ISO-8859-1')))"))
    return files.withColumn("error", F.when(at == 0, F.lit("ValueError: not a PDF"))).withColumn("content", body).withColumn("sha256", F.sha2("content", 256))


def sync_status(manifest: DataFrame, landed: DataFrame) -> DataFrame:
    """``doc_id``, ``status``: unchanged, new, changed or failed, and the hash to keep. ``landed``: doc_id, sha256, error.

    A document without a landed file has failed; the manifest's old hash isn't kept for what changed.
    """
    m = manifest.select("doc_id", F.nullif(F.trim("sha256"), F.lit("")).alias("known"))
    j = m.join(landed.select("doc_id", F.col("sha256").alias("now"), "error"), "doc_id", "left")
    status = F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), "error")).when(F.col("now").isNull(), "failed: not landed")
    status = status.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("now"), "unchanged").otherwise("changed")
    return j.select("doc_id", status.alias("status"), F.coalesce("now", "known").alias("sha256"))


def status_histogram(status: DataFrame) -> DataFrame:
    return status.groupBy(F.split("status", ":")[0].alias("status")).agg(F.count(F.lit(1)).alias("n"))


def unparsed(manifest: DataFrame, parsed: DataFrame) -> DataFrame:
    """Documents whose hash differs from that of the last parse, or that were never parsed. ``parsed``: doc_id, sha256."""
    return manifest.join(parsed.select("doc_id", "sha256"), ["doc_id", "sha256"], "left_anti")
