"""Intermediate tables in the folder that the whole cluster shares.

Iterative jobs cut their lineage by writing Parquet below ``spark.checkpoint.dir``:
every executor can read it again after another is lost, columns stay prunable and
the files are compressed.  Where that setting is missing (plain local sessions, as in
tests) a folder below the warehouse is used; on a cluster its lack is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/petrel-{spark.sparkContext.applicationId}"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` as a scratch table; the table read again, and its path for ``drop``. ``codec``: zstd for tables with texts.

    The files go when the application ends, if ``drop`` has not removed them before.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later action reads."""
    for path in paths:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows in the session's Arrow batches: ten thousand texts at once, the default, are too much for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(key, rows)
