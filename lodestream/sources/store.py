"""Tables on storage: collections with a fingerprint, versions swapped as a whole, text formats."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestream.operators.retrieve import fingerprint
from lodestream.schemas import BULLETIN


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_version(df: DataFrame, root: str, partition: Sequence[str] = (), label: str = "") -> str:
    """Write a new version of a table. A version counts once it is complete, and the newest complete one is current: nothing is
    overwritten, so readers see the old or the new one, never a part and never none."""
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}{'-' + label if label else ''}"
    writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{root}/{version}")
    return version


def versions(spark: SparkSession, root: str) -> list[str]:
    """The complete versions, oldest first."""
    jvm, fs = _fs(spark, root)
    at = jvm.org.apache.hadoop.fs.Path(root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("v-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{root}/{versions(spark, root)[-1]}")


def build_collection(chunks: DataFrame, root: str, columns: Sequence[str] | None = None, rebuild: bool = False) -> bool:
    """Write a collection of chunks unless the current one has the same fingerprint and count; whether it was written.

    The fingerprint is over all columns, vectors included, or the given ones; it is part of the version's name, so rows and
    fingerprint can't part. Rows are keyed by chunk_id and partitioned by is_current, the filter that nearly every
    search has.
    """
    spark = chunks.sparkSession
    stamp = fingerprint(chunks, columns or chunks.columns).first()
    label = f"{stamp['stamp']}-{stamp['n']}"
    known = versions(spark, f"{root}/rows")
    if not rebuild and known and known[-1].endswith(label):
        return False
    write_version(chunks, f"{root}/rows", ["is_current"] if "is_current" in chunks.columns else [], label)
    return True


def upsert(chunks: DataFrame, root: str, key: str = "chunk_id") -> bool:
    """The collection with these rows in the place of those of the same key; whether anything changed. Of rows of one key any one."""
    spark, fresh = chunks.sparkSession, chunks.dropDuplicates([key])
    if not versions(spark, f"{root}/rows"):
        return build_collection(fresh, root)
    old = current(spark, f"{root}/rows")
    return build_collection(old.join(fresh.select(key), key, "left_anti").select(*chunks.columns).unionByName(fresh), root)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema."""
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_bulletins(spark: SparkSession, path: str) -> DataFrame:
    """Bulletin rows from CSV with pinned types."""
    return spark.read.csv(path, schema=BULLETIN, header=True)


def write_bulletins(df: DataFrame, path: str) -> None:
    df.select(*BULLETIN.names).write.mode("overwrite").csv(path, header=True)
