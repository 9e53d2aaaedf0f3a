"""Readers: images, listings, notes, traces, logs, catalogs, manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrel.functions import text as T

# Suffixes of notes and of listings.
NOTE_SUFFIXES = ("md", "txt", "asm", "s", "inc", "log")
LISTING_SUFFIXES = ("asm", "s", "txt", "lst")
NOTE_BYTES = 1 << 20

EVENT = "id string, ts string, kind string, source string, payload string"
TURN = "run_id string, ts string, question string, answer string, verdict string, confidence double"


def dumps(spark: SparkSession, *paths: str) -> DataFrame:
    """``dump_id, sha256, content, modified``: images as binary files, cut at 64 KiB."""
    f = spark.read.format("binaryFile").load(list(paths))
    return f.select(F.col("path").alias("dump_id"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 0x10000).alias("content"), F.col("modificationTime").alias("modified"))


def freshness(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """``state``: new, current or changed against the latest ingest of the path; a legacy ingest without a hash counts by size and time.

    ``files``: ``path, sha256, size, mtime``; ``ingested``: the same and ``log_pos``.
    """
    last = ingested.groupBy("path").agg(F.max_by(F.struct("sha256", "size", "mtime"), "log_pos").alias("_l"))
    same = F.when(F.col("_l.sha256").isNotNull(), F.col("_l.sha256") == F.col("sha256")).otherwise((F.col("_l.size") == F.col("size")) & (F.col("_l.mtime") == F.col("mtime")))
    state = F.when(F.col("_l").isNull(), "new").when(same, "current").otherwise("changed")
    return files.join(last, "path", "left").select(*files.columns, state.alias("state"), (F.col("_l").isNotNull() & F.col("_l.sha256").isNull()).alias("needs_sha"))


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``source_file, line_no, line`` with lines numbered within their file."""
    whole = spark.read.text(list(paths), wholetext=True).withColumn("source_file", F.input_file_name())
    return split_lines(whole.withColumnRenamed("value", "content"), "source_file")


def split_lines(docs: DataFrame, key: str, content: str = "content") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(content, r"\r?\n")).alias("line_no", "line"))


_INSTRUCTION = r"^\s*\$?([0-9a-fA-F]{4})\s*:?\s+((?:[0-9a-fA-F]{2}\s){0,3}[0-9a-fA-F]{2})\s+([A-Za-z]{2,4})(?:\s+(.*?))?\s*$"
_LABEL = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*:\s*(?:;.*)?$"
# Ends of a gap are read whole where they are numbers of five to seven digits, which writers of four digits at least make of ends beyond $FFFF.
_GAP = r"(?i)gap[: \t]*\$?([0-9a-f]{4,7})\s*[-–—]\s*\$?([0-9a-f]{4,7}\b|[0-9a-f]{4})"


def classify_lines(lines: DataFrame, key: str = "source_file") -> DataFrame:
    """Each line's type: blank, comment, instruction, label or skipped, with its parts."""
    bare = F.trim("line")
    part = lambda rx, i: F.regexp_extract("line", rx, i)
    kind = F.when(bare == "", "blank").when(bare.rlike(r"^(?:;|#|//)"), "comment").when(F.col("line").rlike(_INSTRUCTION), "instruction").when(F.col("line").rlike(_LABEL), "label").otherwise("skipped")
    hexed = lambda c: F.when(c != "", F.conv(c, 16, 10).cast("int"))
    return lines.withColumn("type", kind).withColumns({
        "addr": F.when(F.col("type") == "instruction", hexed(part(_INSTRUCTION, 1))), "bytes_hex": F.when(F.col("type") == "instruction", F.upper(F.trim(part(_INSTRUCTION, 2)))),
        "mnemonic": F.when(F.col("type") == "instruction", F.lower(part(_INSTRUCTION, 3))), "raw_operand": F.when(F.col("type") == "instruction", F.trim(F.regexp_replace(part(_INSTRUCTION, 4), r"\s*;.*$", ""))),
        "label": F.when(F.col("type") == "label", part(_LABEL, 1)), "gap_start": F.when(F.col("type") == "comment", hexed(part(_GAP, 1))), "gap_end": F.when(F.col("type") == "comment", hexed(part(_GAP, 2))),
    })


def parse_listing(lines: DataFrame, key: str = "source_file") -> dict[str, DataFrame]:
    """Instructions, labels, gaps and counters of listings.

    A label belongs to the next instruction, one after the last instruction to that one.
    """
    c = classify_lines(lines, key)
    ahead, behind = (Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.desc("line_no"), F.asc("line_no")))  # growing frames only: one that shrinks is summed anew for each line
    size = F.size(F.split("bytes_hex", r"\s+"))
    code = c.where("type = 'instruction'").select(key, "line_no", "addr", "bytes_hex", "mnemonic", T.canonical_operand(F.col("raw_operand")).alias("operand"), "raw_operand", size.alias("size"))
    placed = c.where("type in ('instruction', 'label')").select(key, "line_no", "type", "addr", "label")
    placed = placed.withColumn("_next", F.last("addr", True).over(ahead)).withColumn("_last", F.last("addr", True).over(behind))
    labels = placed.where("type = 'label'").select(key, F.coalesce("_next", "_last").alias("addr"), F.col("label").alias("name"), F.col("line_no").alias("ord")).where("addr is not null")
    gaps = c.where("gap_start is not null and gap_end >= gap_start").select(key, "gap_start", "gap_end")
    counters = c.groupBy(key).agg(F.count("*").alias("total_lines"), F.count_if(F.col("type") == "skipped").alias("skipped_lines"))
    return {"instructions": code, "labels": labels, "gaps": gaps, "counters": counters}


def listing_names(lines: DataFrame, key: str = "source_file") -> DataFrame:
    """``addr, name`` pairs of partial listings: the first identifier after an address.

    As in the behaviour it mirrors, that may be a mnemonic or a byte pair that starts with a letter.
    """
    rx = r"^\s*\$?([0-9A-Fa-f]{4})\b[^A-Za-z_]*([A-Za-z_][A-Za-z0-9_]*)"
    rows = lines.where(~F.trim("line").startswith(";") & F.col("line").rlike(rx))
    return rows.select(key, F.conv(F.regexp_extract("line", rx, 1), 16, 10).cast("int").alias("addr"), F.regexp_extract("line", rx, 2).alias("name"))


def notes(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """``path, content, size, mtime`` of note files below a folder, cut at 1 MiB with a marker."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = f.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*NOTE_SUFFIXES))
    if since is not None:
        f = f.where(F.col("modificationTime") > F.lit(since).cast("timestamp"))
    text = F.call_function("try_validate_utf8", F.substring("content", 1, NOTE_BYTES))
    text = F.coalesce(text, F.make_valid_utf8(F.substring("content", 1, NOTE_BYTES).cast("string")))
    return f.select("path", F.concat(text, F.when(F.col("length") > NOTE_BYTES, F.lit("\n…[truncated]")).otherwise("")).alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def event_log(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """Events of JSON lines; a bad line raises, blank ones are skipped; payloads stay JSON text."""
    lines = spark.read.text(list(paths)).where(F.trim("value") != "")
    p = F.from_json("value", EVENT, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    payload = F.get_json_object("value", "$.payload")
    return lines.select(p.alias("e"), payload.alias("_p")).select("e.id", "e.ts", "e.kind", "e.source", F.coalesce("_p", "e.payload").alias("payload")).where("id is not null")


def notebook(spark: SparkSession, *paths: str, schema: str = TURN) -> DataFrame:
    """Turns or ratings; lines that are no JSON object are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(list(paths)).where("run_id is not null")


def snapshot_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``name, file, sha256, notes`` of a catalog's states."""
    schema = "version int, states array<struct<name:string,file:string,sha256:string,notes:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline("states"))


def resolve_snapshots(wanted: DataFrame, files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Names to places: the reserved ``dump``, then a snapshot file, then the catalog."""
    f = files.select("name", F.col("path").alias("_file"))
    c = catalog.select("name", F.col("file").alias("_cat"))
    place = F.when(F.col("name") == "dump", F.lit("dump")).otherwise(F.coalesce("_file", "_cat"))
    return wanted.join(f, "name", "left").join(c, "name", "left").select(*wanted.columns, place.alias("place"))


def monitor_rows(lines: DataFrame, key: str = "source_file") -> DataFrame:
    """``addr, bytes_hex, mnemonic, operand`` of monitor text rows."""
    rx = r"^\s*(?:\.C:|\.)?\$?([0-9A-Fa-f]{4})[:\s]+((?:[0-9A-Fa-f]{2}\s+){1,3})([A-Za-z]{3})\b\s*([^-;]*)"
    rows = lines.where(F.col("line").rlike(rx))
    return rows.select(key, "line_no", F.conv(F.regexp_extract("line", rx, 1), 16, 10).cast("int").alias("addr"), F.upper(F.trim(F.regexp_replace(F.regexp_extract("line", rx, 2), r"\s+", " "))).alias("bytes_hex"), F.lower(F.regexp_extract("line", rx, 3)).alias("mnemonic"), F.trim(F.regexp_extract("line", rx, 4)).alias("operand"))


def trace_rows(lines: DataFrame, key: str = "trace_id") -> DataFrame:
    """``line_no, addr, n_bytes, mnemonic, operand`` of execution traces.

    Lines start with ``.C:`` and have four tokens or more; bytes run up to the first token of
    three letters, the operand up to the first token that starts with a hyphen.
    """
    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    t = lines.where(F.col("line").startswith(".C:")).withColumn("t", tokens).where(F.size("t") >= 4)
    at = F.array_position(F.transform("t", lambda x: x.rlike(r"^[A-Za-z]{3}$")), F.lit(True)).cast("int")
    t = t.withColumn("m", at).where("m > 1")
    rest = F.col("t")
    stop = F.array_position(F.transform(rest, lambda x, i: (i >= F.col("m")) & x.startswith("-")), F.lit(True)).cast("int")
    last = F.when(stop > 0, stop - 1).otherwise(F.size("t"))
    operand = F.array_join(F.slice("t", F.col("m") + 1, F.greatest(F.lit(0), last - F.col("m"))), " ")
    return t.select(key, "line_no", F.conv(F.substring(F.col("t")[0], 4, 8), 16, 10).cast("int").alias("addr"), (F.col("m") - 2).alias("n_bytes"), F.lower(F.element_at("t", F.col("m"))).alias("mnemonic"), operand.alias("operand"))


def game_tokens(game: str) -> list[str]:
    return [t for t in re.split(r"[\s_-]+", game.strip().lower()) if len(t) >= 3]


def scope_files(files: DataFrame, game: str, override: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Listing files of a game: those named, else its folder's, else those whose name has its tokens, and the extras.

    ``files``: ``path`` below the listing folder, ``folder``, ``name``.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*LISTING_SUFFIXES)
    listed = files.where(suffix)
    more = listed.where(F.col("path").isin(*extra)) if extra else listed.limit(0)
    if override:
        return listed.where(F.col("path").isin(*override)).unionByName(more).distinct()
    slug = re.sub(r"[^a-z0-9]+", "-", game.strip().lower()).strip("-")
    in_folder = listed.where(F.lower("folder").isin(slug, slug.replace("-", "_"))).withColumn("_r", F.lit(0))
    token = F.lit(False)
    for t in game_tokens(game):
        token = token | F.lower("name").contains(t)
    by_name = listed.where(token).withColumn("_r", F.lit(1))
    every = in_folder.unionByName(by_name)
    best = every.withColumn("_m", F.min("_r").over(Window.partitionBy())).where("_r = _m").drop("_r", "_m")  # one game's files
    return best.unionByName(more).distinct()


def split_candidates(files: DataFrame, game: str) -> DataFrame:
    """Dumps with ``matched``: whether the name has one of the game's tokens."""
    token = F.lit(False)
    for t in game_tokens(game):
        token = token | F.lower("name").contains(t)
    return files.withColumn("matched", token)


GOLDEN = "id string, game string, question string, dump_path string, asm_files array<string>, expected_addresses array<string>, expected_keywords array<string>, min_confidence double"


def golden_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases with ``problems``; repeated ids, missing fields and bad values are listed, not dropped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    c = lines.select(F.from_json("value", GOLDEN).alias("c")).select("c.*")
    n = F.count("*").over(Window.partitionBy("id"))
    rules = {"duplicate id": n > 1, "no id": F.col("id").isNull(), "no question": F.coalesce(F.trim("question"), F.lit("")) == "", "bad confidence": ~F.coalesce(F.col("min_confidence").between(0, 1), F.lit(True)),
             "bad address": F.exists(F.coalesce("expected_addresses", F.array().cast("array<string>")), lambda a: T.parse_address(a).isNull())}
    return c.withColumn("problems", F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()])))


def log_column(rows: DataFrame) -> Column:
    """JSON of a row's columns, keys in order, for payloads."""
    return F.to_json(F.struct(*sorted(rows.columns)))
