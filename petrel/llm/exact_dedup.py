"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .skew import join_keyed

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Level 1 counts lengths, level 2 counts (length, prefix hash) among lengths that occur
    twice, level 3 takes the SHA-256 of the whole text and compares only rows whose first
    two levels are shared.  Texts are read, never shuffled, with ``digest_all``: once, into a
    saved table of a few numbers and the hash, which all counts and joins then read.  Counts
    are pre-aggregated where rows lie; groups of more than a thousandth of all rows are joined
    by a broadcast of fewer than a thousand rows, so no task gets a hot group.

    ``digest_all``: also return the hash of texts that cannot have an equal; they are then
    hashed, yet not grouped.  Otherwise their ``text_sha256`` is null, and only the texts that
    survive the first two levels are hashed, in a second reading.

    Null and empty texts are equal.  Long texts are hashed whole.  Rows that repeat a doc_id
    with an equal text count in ``group_size`` and share ``kept``.  A null doc_id is never the
    one that stays unless all of its group are null (then ``keep_id`` is null and they are
    kept).  Ties of doc_id are ties of rows, which are all marked alike.  Columns other than
    doc_id and text are ignored.  Empty table: no rows.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", normalised(F.col("text")).alias("_t"))
    level = text.select("doc_id", F.length("_t").alias("_n"), F.xxhash64(F.substring("_t", 1, prefix_chars)).alias("_p"), "_t")
    digest = F.sha2(F.col("_t").cast("binary"), 256)
    rows, path = scratch.save(level.select("doc_id", "_n", "_p", *[digest.alias("_h")] * digest_all), "levels")
    pairs = rows.groupBy("_n", "_p").agg(F.count("*").alias("_c"))
    lengths = pairs.groupBy("_n").agg(F.sum("_c").alias("_cn")).where("_cn > 1").select("_n")
    shared, shared_path = scratch.save(pairs.where("_c > 1").join(lengths, "_n", "left_semi").select("_n", "_p", "_c"), "shared")
    if digest_all:
        hashed = join_keyed(rows, shared, ["_n", "_p"], "_c", "left")
    else:
        hashed = join_keyed(level, shared, ["_n", "_p"], "_c", "left").withColumn("_h", F.when(F.col("_c").isNotNull(), digest)).drop("_t")
    hashed, _ = scratch.save(hashed.select("doc_id", "_n", "_p", "_h", F.col("_c").isNotNull().alias("_shared")), "hashed")
    scratch.drop(spark, path, shared_path)
    groups = hashed.where("_shared").groupBy("_n", "_p", "_h").agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    groups, _ = scratch.save(groups, "groups")
    open_rows = hashed.where("_shared").select("doc_id", "_n", "_p", "_h")
    out = join_keyed(open_rows, groups, ["_n", "_p", "_h"], "_size", "left").select("doc_id", "_h", "_keep", "_size")
    alone = hashed.where("not _shared").select("doc_id", "_h", F.lit(None).cast(groups.schema["_keep"].dataType).alias("_keep"), F.lit(None).cast("long").alias("_size"))
    out = out.unionByName(alone)
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("_h").alias("text_sha256"),
    )
