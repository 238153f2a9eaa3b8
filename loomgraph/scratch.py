"""Intermediate tables in the cluster's shared folder: they cut lineage, and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a session on one machine uses a local folder; on a cluster, whose executors share no local folder, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes inside drop their shuffle files when they end; else these stay on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch(spark)
    with tidy(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path; no rows where nothing is stored yet."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that no later plan reads; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_loomgraph_path", None)
        if path:
            context = df.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
