"""Views kept up to date from a stream of events, equal to the batch fold on finite input (§2.14, P11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from petrel.operators import fold


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The append-only log as a stream; Spark's checkpoint is the offset and the fingerprint."""
    return spark.readStream.schema(schema).parquet(path)


def strongest_view(log: DataFrame, *keys: str) -> DataFrame:
    """Compare-and-swap by confidence as streaming state per key, for update or complete mode."""
    rest = [c for c in log.columns if c not in keys]
    rank = F.struct(F.coalesce("confidence", F.lit(0.5)), "log_pos")
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("x"))


def once_per_key(log: DataFrame, *keys: str) -> DataFrame:
    """Idempotent append: first row of a key, with no expiry, as the log never forgets."""
    return log.dropDuplicates(list(keys))


def fold_batches(log: DataFrame, view_path: str, checkpoint: str, keys: list[str], merge: Callable[[DataFrame, list[str]], DataFrame] = fold.strongest_write) -> StreamingQuery:
    """Re-fold the keys that each micro-batch touches and write them as the batch's version of the view.

    A version holds the folded rows of its keys; ``current_view`` takes the last per key.  A
    batch that is run again overwrites its own version, so results are exactly once.
    """

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = batch.select(*keys).distinct()
        old = versions(spark, view_path, batch.schema, before=batch_id)
        known = current(old, keys).join(touched, keys, "left_semi").select(*batch.columns) if old is not None else batch.limit(0)
        merge(known.unionByName(batch), keys).select(*batch.columns).write.mode("overwrite").parquet(f"{view_path}/version={batch_id}")

    return log.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, view_path: str, schema, before: int | None = None) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(view_path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    whole = schema if "version" in schema.names else StructType([*schema.fields, StructField("version", IntegerType())])
    rows = spark.read.schema(whole).parquet(view_path)
    return rows.where(F.col("version") < before) if before is not None else rows


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    return fold.last_write(rows, keys, "version")


def current_view(spark: SparkSession, view_path: str, schema, keys: list[str]) -> DataFrame:
    """Last version of every key."""
    return current(versions(spark, view_path, schema), keys).drop("version")
