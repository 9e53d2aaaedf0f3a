"""Substring search by an index: postings of character trigrams prune the documents before the exact check.

A document that contains a text contains all its trigrams.  Postings lie in buckets of the
trigram's hash, so a search opens a folder per trigram of the query and, within it, the row
groups that may hold the trigram.  Texts are read for the candidates only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Buckets of the postings: as many folders.
BUCKETS = 64
#: Texts of an Arrow batch.
BATCH = 500


@F.pandas_udf(ArrayType(StringType()))
def _runs(text: pd.Series) -> pd.Series:
    return text.map(lambda t: ["".join(g) for g in dict.fromkeys(zip(t, t[1:], t[2:], strict=False))], na_action="ignore")


def trigrams(text: Column) -> Column:
    """Distinct runs of three code points of a text in small letters; none if it is shorter, null if it is null."""
    return _runs(F.lower(text))


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, key: str = "path", content: str = "content", buckets: int = BUCKETS) -> DataFrame:
    """``gram, key, bucket``: each trigram of each document once. Null texts have none."""
    conf, limit = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(limit, "10000")) <= BATCH:
        conf.set(limit, BATCH)
    rows = docs.select(F.col(key).alias("key"), F.explode(trigrams(F.coalesce(content, F.lit("")))).alias("gram"))
    return rows.select("gram", "key", bucket(F.col("gram"), buckets).alias("bucket"))


def write_postings(docs: DataFrame, path: str, key: str = "path", content: str = "content", buckets: int = BUCKETS, files: int = 1) -> None:
    """The index as a table: a folder per bucket, its files sorted by trigram, so that their statistics prune.

    A frequent trigram is no hot task: rows of a bucket are dealt by key to ``files`` files.
    """
    rows = postings(docs, key, content, buckets)
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("key"), F.lit(files))).sortWithinPartitions("bucket", "gram")
    dealt.write.partitionBy("bucket").parquet(path)


def query_grams(spark: SparkSession, query: str) -> list[str]:
    """The trigrams of a query by the same rule as those of texts."""
    return sorted(spark.range(1).select(trigrams(F.lit(query)).alias("g")).first()["g"])


def candidates(index: DataFrame, query: str, buckets: int = BUCKETS) -> DataFrame | None:
    """``key`` of the documents that have all trigrams of the query; None if it is too short to have one."""
    grams = query_grams(index.sparkSession, query)
    if not grams:
        return None
    wanted = index.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(bucket(F.col("gram"), buckets).alias("b"))
    places = sorted({r["b"] for r in wanted.collect()})  # one number per trigram of the query
    rows = index.where(F.col("bucket").isin(places) & F.col("gram").isin(grams))
    return rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("key")


def containing(docs: DataFrame, index: DataFrame, query: str, key: str = "path", content: str = "content", buckets: int = BUCKETS) -> DataFrame:
    """``key, match_at`` of the documents that contain the query, whatever the case, as a scan of all texts would find them.

    Queries of fewer than three characters scan.
    """
    found = candidates(index, query, buckets)
    some = docs.select(key, content) if found is None else docs.select(key, content).join(found.withColumnRenamed("key", key), key, "left_semi")
    at = F.instr(F.lower(content), F.lower(F.lit(query))) - 1
    return some.select(key, at.alias("match_at")).where("match_at >= 0")
