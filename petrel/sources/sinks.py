"""Writers: appends that are idempotent by key, exports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrel.functions import text as T


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or no rows of the same columns if it isn't there yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(like.schema).parquet(path) if there else like.limit(0)


def append_events(events: DataFrame, path: str) -> None:
    """One batched append with ids and times where they are missing (K1, K2)."""
    made = events.withColumns({"id": F.coalesce("id", F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)), "ts": F.coalesce("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))})
    made.write.mode("append").parquet(path)


def append_once(rows: DataFrame, path: str, *keys: str, order: str | None = None) -> None:
    """Append rows whose key the table lacks, each key once (K3, K6, K9)."""
    fresh = rows.dropDuplicates(list(keys)) if order is None else rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_x")).select(*keys, "_x.*")
    old = read_or_empty(rows.sparkSession, path, rows)
    fresh.select(*rows.columns).join(old.select(*keys), list(keys), "left_anti").write.mode("append").parquet(path)


def append_ratings(ratings: DataFrame, path: str, most: int = 2000) -> None:
    """A rating that equals the latest of its run changes nothing; another is the next revision (K7)."""
    r = ratings.withColumn("comment", F.substring("comment", 1, most))
    like = r.withColumn("revision", F.lit(1))
    last = read_or_empty(r.sparkSession, path, like).groupBy("run_id").agg(F.max_by(F.struct("rating", "comment", "revision"), "revision").alias("_l"))
    j = r.join(last, "run_id", "left")
    fresh = j.where(F.col("_l").isNull() | ~(F.col("_l.rating").eqNullSafe(F.col("rating")) & F.col("_l.comment").eqNullSafe(F.col("comment"))))
    fresh.select(*r.columns, (F.coalesce("_l.revision", F.lit(0)) + 1).alias("revision")).write.mode("append").parquet(path)


def freeze_snapshots(snaps: DataFrame, path: str) -> None:
    """Images of exactly 64 KiB under normal names; the same name with other bytes is an error (K8)."""
    s = snaps.select(T.slug(F.col("name")).alias("name"), "content", F.sha2("content", 256).alias("sha256"))
    old = read_or_empty(s.sparkSession, path, s)
    j = s.join(old.select("name", F.col("sha256").alias("_old")), "name", "left")
    size = F.when(F.length("content") == 0x10000, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not 65,536 bytes: "), "name")).cast("binary"))
    same = F.when(F.col("_old").isNull() | (F.col("_old") == F.col("sha256")), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("frozen with other bytes: "), "name")))
    j.withColumns({"content": size, "name": same}).where("_old is null").select("name", "content", "sha256").write.mode("append").parquet(path)


def commented_listing(code: DataFrame, routines: DataFrame, labels: DataFrame, hypotheses: DataFrame, key: str = "source_file") -> DataFrame:
    """``key, ord, line``: gap comments, routine headers with confidence tags, resolved names (K4).

    ``routines``: ``start_addr, name, confidence``; ``hypotheses``: ``start_addr, name, confidence``.
    """
    best = hypotheses.where("confidence >= 0.6").groupBy("start_addr").agg(F.max_by("name", F.struct("confidence", "name")).alias("_h"))
    r = routines.select("start_addr", "name", "confidence").join(best, "start_addr", "left").withColumn("shown", F.coalesce("_h", "name"))
    names = r.select(F.col("start_addr").alias("_a"), F.col("shown").alias("_n"), F.lit(0).alias("_r")).unionByName(labels.select(F.col("addr").alias("_a"), F.col("name").alias("_n"), F.lit(1).alias("_r")))
    names = names.groupBy("_a").agg(F.min_by("_n", F.struct("_r", "_n")).alias("_n"))
    w = Window.partitionBy(key).orderBy("addr")
    rows = code.withColumns({"_end": F.lag(F.col("addr") + F.col("size")).over(w), "_to": T.direct_target(F.col("operand"))})
    rows = rows.join(r.select(F.col("start_addr").alias("addr"), "shown", "confidence"), "addr", "left").join(names, F.col("_to") == F.col("_a"), "left")
    tag = F.when(F.col("confidence") < 0.5, " [low]").when(F.col("confidence") < 0.75, " [med]").otherwise("")
    gap = F.when(F.col("_end") != F.col("addr"), F.concat(F.lit("; gap "), T.hex_label(F.col("_end")), F.lit("-"), T.hex_label(F.col("addr") - 1)))
    head = F.when(F.col("shown").isNotNull(), F.concat("shown", F.lit(":"), tag))
    line = F.rtrim(F.concat(F.lit("  "), T.hex_label(F.col("addr")), F.lit("  "), F.rpad("bytes_hex", 9, " "), F.upper("mnemonic"), F.lit(" "), F.coalesce("_n", "operand")))
    return rows.select(key, "addr", F.posexplode(F.array_compact(F.array(gap, head, line))).alias("part", "line")).orderBy(key, "addr", "part")


def symbols(named: DataFrame, least: float = 0.75) -> DataFrame:
    """``addr, symbol, confidence``: the surest name per address, the first on ties (K5).

    ``named``: ``addr, name, confidence, flags, ord``.  Flagged and placeholder names stay out.
    """
    clean = T.identifier(F.col("name"), 200)
    clean = F.substring(F.when(F.trim("name").rlike(r"^[0-9]"), F.concat(F.lit("sym"), clean)).otherwise(clean), 1, 64)
    ok = (F.col("confidence") >= least) & ~F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "unverified_llm")
    n = named.where(ok).withColumn("symbol", clean).where((F.col("symbol") != "") & ~F.lower("symbol").startswith("sub_") & ~F.lower("symbol").startswith("loc_"))
    return n.groupBy("addr").agg(F.min_by(F.struct("symbol", "confidence"), F.struct(-F.col("confidence"), "ord")).alias("_x")).select("addr", "_x.*")


def symbol_lines(named: DataFrame, least: float = 0.75) -> DataFrame:
    s = symbols(named, least)
    return s.select("addr", F.concat(F.lit("al "), T.hex_label(F.col("addr")), F.lit(" ."), "symbol", F.lit(" ; confidence="), F.format_number("confidence", 2)).alias("line")).orderBy("addr")


def trace_lines(reduced: DataFrame) -> DataFrame:
    """Unique trace as lines with overlap comments, by address."""
    note = lambda c, word: F.when(F.size(F.coalesce(c, F.array().cast("array<int>"))) > 0, F.concat(F.lit(f" ; {word} "), F.array_join(F.transform(c, lambda a: T.hex_label(a)), ", "))).otherwise("")
    line = F.rtrim(F.concat(T.hex_label(F.col("addr")), F.lit("  "), F.upper("mnemonic"), F.lit(" "), "operand"))
    return reduced.select("trace_id", "addr", F.concat(line, note(F.col("inside_of"), "inside"), note(F.col("contains"), "contains")).alias("line")).orderBy("trace_id", "addr")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text of one export: one file, since the result is one listing of 64 KiB of code at most."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)


def golden_results(results: DataFrame, path: str) -> None:
    """One JSON object per case, keys sorted."""
    results.select(*sorted(results.columns)).write.mode("append").json(path)


def payload_json(*columns: str) -> Column:
    return F.to_json(F.struct(*sorted(columns)))
