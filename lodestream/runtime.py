"""Session helpers: table access, durable cuts of the lineage, shipping the package to executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


_OWN: set[str] = set()
_TABLES: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where a local session has none (tests, a single machine) a folder of this process under the working
    directory's ``.lodestream`` becomes it, and goes with the process; a cluster has to name its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.abspath(f".lodestream/{os.getpid()}")
        if own not in _OWN:
            _OWN.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a table written to the shared folder, so that a lost executor costs no recomputation upstream.

    Unlike a checkpoint the table is compressed, read by column, and its size is known to the planner. It goes
    with the process.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "cut")
    df.write.parquet(path)
    _written(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores, where it has fewer partitions than there are cores (small inputs in few files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int = 200_000, size: int = 64 << 20) -> DataFrame:
    """A durable table or a plain part of one, with the hint to broadcast it if it was counted to hold ``rows`` rows at most and
    its files hold ``size`` bytes at most; else joins shuffle it."""
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return broadcast(df) if held <= size and df.count() <= rows else df


def _written(spark: SparkSession, path: str) -> None:
    """Remembers a written table, to be removed at the end of the process or by ``release``."""
    if not _TABLES:
        atexit.register(release)
    _TABLES.append((spark, path))


def release() -> None:
    """Removes all tables that this process has cut lineages with; frames read from them can't be used any more."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of a remote cluster (no-op on local masters).

    The archive goes to the shared folder, from where every executor fetches it.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local") or getattr(sc, "_lodestream_shipped", False):
        return
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(str(f.relative_to(root.parent)), f.read_bytes())
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'package')}/lodestream.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    sc._lodestream_shipped = True
