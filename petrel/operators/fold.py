"""Event logs to views: folds, invalidation, promotion, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(log: DataFrame, keys: Sequence[str], order: str = "log_pos") -> DataFrame:
    """Latest row per key (P3). The aggregate is combined before the shuffle, so a hot key is no hot task."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")


def first_write(log: DataFrame, keys: Sequence[str], order: str = "log_pos") -> DataFrame:
    """Earliest row per key; nulls in keys are equal."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")


def strongest_write(log: DataFrame, keys: Sequence[str], confidence: str = "confidence", order: str = "log_pos", default: float = 0.5) -> DataFrame:
    """Running maximum of confidence, ties to the later row: what compare-and-swap in order leaves."""
    rest = [c for c in log.columns if c not in keys]
    rank = F.struct(F.coalesce(F.col(confidence), F.lit(default)), F.col(order))
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_x")).select(*keys, "_x.*")


def number_log(log: DataFrame, *order: str) -> DataFrame:
    """``log_pos`` 1..N in append order, an id that comes again keeping its number.

    ``order`` is total. Rows are dealt to ranges by bounds that are values, so that counts and places
    refer to the same ranges however often, and on whatever partitions, Spark computes them; bounds
    only balance the ranges, and no task holds the whole log.
    """
    once = first_write(log.withColumn("_k", F.struct(*order)), ["id"], "_k").drop("_k")
    firsts = log.select(F.struct(*order).alias("_k")).repartitionByRange("_k").groupBy(F.spark_partition_id()).agg(F.min("_k").alias("_k")).select("_k")
    bounds = log.sparkSession.createDataFrame(firsts.collect(), firsts.schema)  # a row per partition
    ranges = F.broadcast(bounds.agg(F.array_sort(F.collect_list("_k")).alias("_bounds")))
    ranged = once.crossJoin(ranges).withColumn("_range", F.size(F.filter("_bounds", lambda x: x <= F.struct(*order)))).drop("_bounds")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    base = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row per range
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", at).join(F.broadcast(base), "_range").withColumn("log_pos", F.col("_base") + F.col("_at")).drop("_range", "_at", "_base")


def views(events: DataFrame) -> dict[str, DataFrame]:
    """The general store's views from ``id, log_pos, ts, kind, payload`` (payload as JSON) (P1, §1.3)."""

    def of(kind: str, schema: str) -> DataFrame:
        return events.where(F.col("kind") == kind).select("id", "log_pos", "ts", F.from_json("payload", schema).alias("p")).select("id", "log_pos", "ts", "p.*")

    label = of("label", "addr int, name string, kind string, confidence double, source string")
    routine = of("routine", "start int, end int, name string, confidence double, notes string")
    hypothesis = of("hypothesis", "hyp_id string, statement string, status string, confidence double, evidence array<string>")
    hypothesis = hypothesis.withColumn("hyp_id", F.coalesce("hyp_id", "id"))
    return {
        "labels": strongest_write(label, ["addr", "name"]), "routines": strongest_write(routine, ["start"]),
        "data_structures": last_write(of("data_structure", "start int, end int, name string, notes string"), ["start"]),
        "hypotheses": last_write(hypothesis, ["hyp_id"]), "text_docs": last_write(of("text_doc", "path string, content string, size bigint"), ["path"]),
        "run_summaries": first_write(of("run_summary", "run_id string, question string, answer string, verdict string, confidence double"), ["run_id"]),
        "tool_results": last_write(of("tool_result", "content_key string, tool string, ok boolean, data string"), ["content_key"]),
    }


def annotations_to_views(ann: DataFrame) -> dict[str, DataFrame]:
    """The code store's views from ``id, log_pos, layer, kind, range_start, range_end, payload, source_file, confidence``.

    List payloads give instructions, ranges are exploded to bytes where a view is per byte,
    and a source that the payload lacks is read from the evidence text.
    """
    legacy = F.nullif(F.regexp_extract(F.coalesce("evidence_text", F.lit("")), r"(?:source|file)[=: ]+(\S+)", 1), F.lit("")) if "evidence_text" in ann.columns else F.lit(None).cast("string")
    a = ann.withColumn("source_file", F.coalesce("source_file", legacy)).withColumns({"range_start": F.col("range_start").bitwiseAND(0xFFFF), "range_end": F.col("range_end").bitwiseAND(0xFFFF)})
    parse = lambda kind, schema: a.where(F.col("kind") == kind).withColumn("p", F.from_json("payload", schema))
    insn = parse("instructions", "array<struct<addr:int,bytes_hex:string,mnemonic:string,operand:string,size:int>>").select("id", "log_pos", "source_file", F.inline("p"))
    xref = parse("xref", "src int, dst int, via string, kind string").select("id", "log_pos", "source_file", "p.src", "p.dst", "p.via", F.col("p.kind").alias("edge"))
    refs = parse("data_ref", "src int, dst int, access string, index string").select("id", "log_pos", "source_file", "p.*").where("dst is not null")
    smc = parse("smc", "src int, dst int, smc_kind string").select("id", "log_pos", "source_file", "p.*")
    label = parse("label", "addr int, name string").select("id", "log_pos", "source_file", "p.*")
    routine = parse("routine", "name string, entries array<int>, exits array<int>").select("id", "log_pos", "source_file", "confidence", F.col("range_start").alias("start_addr"), F.col("range_end").alias("end_addr"), "p.*")
    per_byte = parse("byte_class", "class string").where("range_end >= range_start").select("id", "log_pos", "source_file", F.explode(F.sequence("range_start", "range_end")).alias("addr"), "p.class")
    return {
        "instructions": last_write(insn, ["addr"]), "code_routines": last_write(routine, ["start_addr"]), "code_labels": last_write(label, ["addr", "name"]),
        "code_class": last_write(per_byte, ["addr"]), "code_xrefs": first_write(xref, ["src", "dst", "via", "edge", "source_file"]),
        "code_data_refs": first_write(refs, ["src", "dst", "access", "index", "source_file"]), "code_smc_sites": first_write(smc, ["src", "dst", "smc_kind", "source_file"]),
    }


def survivors(log: DataFrame, invalidations: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows that no later invalidation of their source removes.

    ``invalidations``: ``pattern, inv_pos``; a pattern may use ``%`` and ``_``.  Patterns meet
    the distinct sources, not the log: plain names by equality, others by what stands before their
    first sign (prefixes of the lengths that occur, collected: a few numbers), and only
    those that begin with a sign are compared with all sources.  Each source is left with
    its last invalidation, and the log meets that by one equi-join.
    """
    last = invalidations.groupBy("pattern").agg(F.max("inv_pos").alias("inv_pos")).withColumn("head", F.regexp_extract("pattern", "^[^%_]*", 0))
    sources = log.select(F.col(source).alias("_s")).where(F.col(source).isNotNull()).distinct()
    wild = last.where(F.col("pattern").contains("%") | F.col("pattern").contains("_"))
    hits = last.where(~F.col("pattern").contains("%")).select(F.col("pattern").alias("_s"), "inv_pos")
    lengths = [r[0] for r in wild.where("head <> ''").select(F.length("head")).distinct().collect()]
    if lengths:
        heads = sources.select("_s", F.explode(F.array_distinct(F.array(*[F.substring("_s", 1, n) for n in lengths]))).alias("head"))
        hits = hits.unionByName(heads.join(wild, "head").where(F.like("_s", F.col("pattern"))).select("_s", "inv_pos"))
    loose = wild.where("head = ''")
    hits = hits.unionByName(sources.join(loose, F.like("_s", F.col("pattern"))).select("_s", "inv_pos"))
    gone = hits.groupBy("_s").agg(F.max("inv_pos").alias("_gone"))
    return log.join(gone, log[source] == gone["_s"], "left").where(F.col("_gone").isNull() | (F.col("log_pos") >= F.col("_gone"))).select(*[log[c] for c in log.columns])


def promote_names(routines: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """``start_addr, name, confidence, promoted, dropped`` after replaying both in log order.

    A layer-1 name of confidence 0.6 or more that is an identifier of 3 to 64 characters adds
    a label and takes over an empty or ``sub_`` name, or one of lower confidence; weaker
    layer-1 hypotheses before it are dropped.  A later routine row replaces the name again.
    A group is the history of one address of one program.
    """
    fields = "start_addr int, name string, confidence double, promoted array<string>, dropped array<string>"
    r = routines.select("start_addr", "log_pos", F.lit("routine").alias("what"), "id", "name", "confidence")
    h = hypotheses.select("start_addr", "log_pos", F.lit("name").alias("what"), "id", F.trim("suggested_name").alias("name"), "confidence")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        name, sure, labels, alive, dropped = None, 0.0, [], {}, []
        exists = False
        for row in pdf.sort_values("log_pos").itertuples():
            c = 0.0 if pd.isna(row.confidence) else float(row.confidence)
            if row.what == "routine":
                name, sure, exists = row.name, c, True
                continue
            alive[row.id] = c
            if c < 0.6 or not isinstance(row.name, str) or not pd.Series([row.name]).str.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{2,63}").iloc[0]:
                continue
            if row.name not in labels:
                labels.append(row.name)
            if not exists or (name and not str(name).strip().lower().startswith("sub_") and c <= sure):
                continue
            name, sure = row.name, c
            weaker = [i for i, v in alive.items() if i != row.id and v < c]
            dropped += weaker
            for i in weaker:
                del alive[i]
        return pd.DataFrame([(int(pdf["start_addr"].iloc[0]), name, sure, labels, dropped)], columns=["start_addr", "name", "confidence", "promoted", "dropped"])

    renamed = r.unionByName(h).withColumnRenamed("name", "name_")

    def with_name(pdf: pd.DataFrame) -> pd.DataFrame:
        return replay(pdf.rename(columns={"name_": "name"}))

    return renamed.groupBy("start_addr").applyInPandas(with_name, fields)


def hypothesis_states(hypotheses: DataFrame, updates: DataFrame) -> DataFrame:
    """Status updates resolved by id, event id, or a prefix that fits one id only; evidence merged in order.

    ``hypotheses``: ``hyp_id, event_id, status, evidence``; ``updates``: ``ref, status, evidence, log_pos``.
    """
    named = lambda c, rank: hypotheses.select("hyp_id", F.col(c).alias("name"), F.lit(rank).alias("rank"))
    exact = updates.join(named("hyp_id", 0).unionByName(named("event_id", 1)), F.col("ref") == F.col("name"))
    rest = updates.join(hypotheses.select(F.col("hyp_id").alias("ref")).unionByName(hypotheses.select(F.col("event_id").alias("ref"))), "ref", "left_anti")
    rest = rest.where(F.length("ref") >= 4)
    lengths = [r[0] for r in rest.select(F.length("ref")).distinct().collect()]  # lengths of ids: a few numbers
    heads = F.array_distinct(F.array(*[F.substring("hyp_id", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    fits = hypotheses.select("hyp_id", F.explode(heads).alias("ref")).groupBy("ref").agg(F.min("hyp_id").alias("hyp_id"), F.max("hyp_id").alias("_last"))
    prefixed = rest.join(fits.where("hyp_id = _last"), "ref").withColumn("rank", F.lit(2))  # a prefix that fits many ids meets none of them
    cols = ["hyp_id", "status", "evidence", "log_pos", "rank"]
    one = Window.partitionBy("hyp_id", "log_pos").orderBy("rank")
    hits = exact.select(*cols).unionByName(prefixed.select(*cols)).withColumn("turn", F.row_number().over(one)).where("turn = 1")
    merged = hits.groupBy("hyp_id").agg(F.max_by("status", "log_pos").alias("new"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("log_pos", "evidence"))), lambda x: F.coalesce(x["evidence"], F.array().cast("array<string>")))).alias("more"))
    j = hypotheses.join(merged, "hyp_id", "left")
    none = F.array().cast("array<string>")
    return j.select("hyp_id", F.coalesce("new", "status").alias("status"), F.array_distinct(F.concat(F.coalesce("evidence", none), F.coalesce("more", none))).alias("evidence"))


def uncompacted(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """Results whose event id no compaction covers; ids decide, never timestamps."""
    covered = summaries.select(F.explode("events_compacted").alias("event_id")).distinct()
    return results.join(covered, "event_id", "left_anti")


def token_estimate(rows: DataFrame, text: str = "payload") -> DataFrame:
    """Characters of all payloads divided by four."""
    return rows.agg(F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4).alias("tokens"))


def backlog_batch(results: DataFrame, summaries: DataFrame, gate: int = 40_000, most: int = 20) -> DataFrame:
    """Oldest uncompacted results, if they are estimated above the gate (P12, §2.14)."""
    left = uncompacted(results, summaries)
    over = token_estimate(left).where(F.col("tokens") > gate).select(F.lit(True).alias("_over"))  # one row or none
    return left.join(F.broadcast(over), F.lit(True), "left_semi").orderBy("ts", "event_id").limit(most)


# Kinds that keep books rather than state facts, and tools that only read.
BOOKKEEPING = ("run_summary", "tool_result", "compaction", "ingest", "usage", "refreshed", "sha_backfill")


def log_stats(log: DataFrame, kind: str = "kind", pos: str = "log_pos", payload: str = "payload") -> DataFrame:
    """``n, last_id, tokens`` per kind: rows, the largest position and the characters of the payloads divided by four."""
    return log.groupBy(kind).agg(F.count("*").alias("n"), F.coalesce(F.max(pos), F.lit(0)).alias("last_id"), F.floor(F.coalesce(F.sum(F.length(payload)), F.lit(0)) / 4).alias("tokens"))


def distinct_facts(events: DataFrame, bookkeeping: Sequence[str] = BOOKKEEPING) -> DataFrame:
    """``facts``: distinct identities of substantive events (P13). ``kind, identity, ok, read_only``."""
    real = events.where(~F.col("kind").isin(*bookkeeping) & F.coalesce("ok", F.lit(True)) & ~F.coalesce("read_only", F.lit(False)))
    return real.agg(F.count_distinct(F.sha2(F.concat_ws("\u0001", "kind", "identity").cast("binary"), 256)).alias("facts"))


# Facts taken per mode of a tool's output.
FACT_CAPS = {"loops": 3, "vectors": 8, "counters": 32, "idioms": 16, "screen": 12}


def mechanical_facts(findings: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Findings as facts, capped per result and mode, with a confidence from the score.

    ``findings``: ``result_id, mode, ord, addr, name, score``.
    """
    caps = caps or FACT_CAPS
    cap = F.create_map(*[x for m, n in caps.items() for x in (F.lit(m), F.lit(n))])[F.col("mode")]
    place = F.row_number().over(Window.partitionBy("result_id", "mode").orderBy("ord"))
    kept = findings.withColumns({"n": place, "cap": cap}).where("n <= cap")
    return kept.select("result_id", "mode", "addr", "name", F.least(F.lit(0.75), 0.4 + F.col("score") / 60).alias("confidence"))


def gate_claims(claims: DataFrame, routines: DataFrame) -> DataFrame:
    """Claims inside a layer-0 routine (the smallest that holds them) are facts, others flagged hypotheses."""
    from .intervals import smallest_containing

    held = smallest_containing(claims, routines, point="addr")
    kind = F.when(F.col("start").isNotNull(), "fact").otherwise("hypothesis")
    return held.withColumns({"kind": kind, "flags": F.when(kind == "hypothesis", F.array(F.lit("outside_layer0"))).otherwise(F.array().cast("array<string>"))})


def catch_up(log: DataFrame, high_water: int, fingerprint: str, expected: str) -> DataFrame:
    """Rows to replay: those past the high-water mark, or all if the prefix is not the one seen before."""
    return log.where(F.col("log_pos") > high_water) if fingerprint == expected else log


def prefix_fingerprint(log: DataFrame, high_water: int) -> Column:
    """Expression for an aggregate over the prefix: order-free, so any partitioning gives the same."""
    within = F.col("log_pos") <= high_water
    return F.sum(F.when(within, F.xxhash64("log_pos", "id").cast("decimal(38,0)")))
