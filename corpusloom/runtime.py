"""Session helpers: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors.

    The folder the cluster names in ``spark.checkpoint.dir`` is used as it is. Only where that setting is absent and
    the session runs in one JVM (tests, local mode) a temporary folder of this machine is made and remembered.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    where = spark.conf.get("corpusloom.scratch.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    where = "file://" + folder
    spark.conf.set("corpusloom.scratch.dir", where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []  # intermediate tables of this process


def release_scratch(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far, and says how many; call it when the results that read them are stored."""
    context = spark.sparkContext
    settings, done = context._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        path = context._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(path.getFileSystem(settings).delete(path, True))
    return done


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``max_rows`` rows, else unchanged (a shuffled join follows).

    Counts at most ``max_rows + 1`` rows, so call it on tables that are cheap to compute (fixed tables, materialized
    results).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
