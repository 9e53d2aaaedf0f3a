"""A view in buckets of its key, folded batch by batch: what a batch reads is bounded by the view, not by the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from petrel.operators import fold

#: Versions of a bucket that stay on disk: the last one, and the one before, which a batch that runs again starts from.
KEPT = 2


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(p)] if system.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class BucketedView:
    """``path/bucket=b/version=v``: folded rows of the keys of a bucket after batch v.

    A batch reads the last version of the buckets that it touches, merges and writes them
    anew; older versions go.  Which buckets it touches is a list of numbers below ``buckets``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, buckets: int = 32, merge: Callable[[DataFrame, list[str]], DataFrame] = fold.strongest_write) -> None:
        self.spark, self.path, self.keys, self.schema, self.buckets, self.merge = spark, path.rstrip("/"), keys, schema, buckets, merge

    def versions(self, bucket: int) -> list[int]:
        """Finished versions of a bucket, ascending."""
        at = f"{self.path}/bucket={bucket}"
        return sorted(v for v in (int(x.partition("=")[2]) for x in _listed(self.spark, at) if x.startswith("version=")) if "_SUCCESS" in _listed(self.spark, f"{at}/version={v}"))

    def sources(self, buckets: list[int], before: int | None = None) -> list[str]:
        """Folders of the last versions, earlier than a batch if one is given."""
        last = {b: max((v for v in self.versions(b) if before is None or v < before), default=None) for b in buckets}
        return [f"{self.path}/bucket={b}/version={v}" for b, v in last.items() if v is not None]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The view as of the last batch."""
        return self._read(self.sources(list(range(self.buckets))))

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch; running it again gives the same."""
        at = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(at.alias("b")).distinct().collect())  # numbers below ``buckets``
        if not touched:
            return
        names = self.schema.names
        merged = self.merge(self._read(self.sources(touched, batch_id)).unionByName(batch.select(*names)), self.keys).select(*names)
        staged = f"{self.path}/_staged/{batch_id}"
        merged.withColumn("bucket", at).write.mode("overwrite").partitionBy("bucket").parquet(staged)
        for b in touched:
            to = f"{self.path}/bucket={b}/version={batch_id}"
            _delete(self.spark, to)
            self.spark.read.schema(self.schema).parquet(f"{staged}/bucket={b}").coalesce(1).write.parquet(to)
            for old in self.versions(b)[:-KEPT]:
                _delete(self.spark, f"{self.path}/bucket={b}/version={old}")
        _delete(self.spark, staged)

    def follow(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """Keep the view from a stream, for what is there now."""
        return log.writeStream.foreachBatch(lambda batch, i: self.absorb(batch, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
