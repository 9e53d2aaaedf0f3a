"""Line dedup over content-defined chunks of lines.

The lines of a text are hashed and a rolling hash runs over the line hashes.  A chunk boundary
lies where the rolling hash over the lines that follow says so (seven places in eight), or the
one over the lines that precede; a chunk goes from there over two lines and eight words, or more
lines until it has them.  Boundaries depend on the chunk's own lines only, so lines inserted or
deleted elsewhere don't shift them.

Chunks that occur in several places are found by their hash.  In documents that have one, each
is extended to the ends of its run: the windows of the same least size at all other places
of these documents are compared too, and repeated ones that overlap a repeated chunk, or
each other in a chain from it, go with it.  All of them are compared byte by byte, and
all lines of repeated ones go but for their first occurrence (smallest doc_id, then first in the text).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .skew import join_keyed

#: A run that is removed has so many lines (blank ones don't count) and words.
MIN_LINES, MIN_WORDS = 2, 8
#: A boundary is where the rolling hash, by so many of its bits, is not zero.
BOUNDARY_BITS = 3
REPORT = ("_n_lines", "_n_removed_lines", "_n_removed_chunks")
_BASE, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def windows(text: bytes, hash_bits: int = 64) -> list[tuple[int, int, int, bool]]:
    """(start, stop, hash, whether it is a chunk) in bytes of the least windows of MIN_LINES lines and MIN_WORDS words, by start.

    Those at whose boundary the rolling hash hits are the chunks. For each line that is not blank there is the shortest such window that begins with it and
    the shortest that ends with it. ``stop`` leaves out the newline after the last line, so a
    window at the end of a text equals one that more lines follow.
    """
    lines = text.split(b"\n")
    begins = [0, *accumulate(len(x) + 1 for x in lines)]
    counts = [len(x.split()) for x in lines]
    real = [i for i, n in enumerate(counts) if n]
    upto = [0, *accumulate(counts[i] for i in real)]
    found, a = set(), 0
    for e in range(MIN_LINES, len(real) + 1):  # lines a to e - 1 are the shortest window up to there
        while a + 1 <= e - MIN_LINES and upto[e] - upto[a + 1] >= MIN_WORDS:
            a += 1
        if upto[e] - upto[a] >= MIN_WORDS:
            found.add((real[a], real[e - 1]))
    e = 0
    for a in range(len(real) - MIN_LINES + 1):
        e = max(e, a + MIN_LINES)
        while e < len(real) and upto[e] - upto[a] < MIN_WORDS:
            e += 1
        if upto[e] - upto[a] >= MIN_WORDS:
            found.add((real[a], real[e - 1]))
    if not found:
        return []
    rolling, out = [0], []
    for x in lines:
        rolling.append((rolling[-1] * _BASE + xxhash.xxh64_intdigest(x) + 1) & _ALL)
    for first, last in sorted(found):
        h = (rolling[last + 1] - rolling[first] * pow(_BASE, last + 1 - first, 1 << 64)) & _ALL
        h = (h ^ (h >> 32)) * _BASE & _ALL
        cut = (h ^ (h >> 29)) * _BASE & _ALL
        out.append((begins[first], begins[last + 1] - 1, (h >> (64 - hash_bits)) - (1 << 63), cut >> (64 - BOUNDARY_BITS) > 0))
    return out


def _owner(doc_id: Column, text: Column) -> Column:
    """A document in the order in which first occurrences are sought: by id (null last), rows that share one by a hash of their texts."""
    return F.struct(doc_id.isNull().alias("late"), doc_id.alias("id"), F.xxhash64(text).alias("k"))


def _occurrences(docs: DataFrame, hash_bits: int) -> DataFrame:
    """``o, h, begin, stop, cut`` of every window of every document; texts stay behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(_owner(F.col("doc_id"), text).alias("o"), text.cast("binary").alias("t"))
    names = ["o", "h", "begin", "stop", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cells = [], []
            for i, t in enumerate(b.column(1)):
                found = windows(t.as_py(), hash_bits)
                row += [i] * len(found)
                cells += found
            begin, stop, h, cut = zip(*cells, strict=True) if cells else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(h, pa.int64()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32()), pa.array(cut, pa.bool_())], names)

    return rows.mapInArrow(run, rows.select("o", F.lit(0).cast("long").alias("h"), F.lit(0).alias("begin"), F.lit(0).alias("stop"), F.lit(True).alias("cut")).schema)


def _attach(docs: DataFrame, marks: DataFrame, path: list[str]) -> DataFrame:
    """``row, marks`` of every document, saved. Texts are shuffled here, once, whatever the size of ``marks``."""
    of_doc = marks.groupBy("o").agg(F.collect_list(F.struct("begin", "stop", "h", "v", "mine", "cut")).alias("marks"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _owner(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))).alias("o"))
    met, at = scratch.save(whole.join(of_doc.hint("merge"), "o", "left").select("row", "o", "marks"), "marked", "zstd")
    path.append(at)
    return met


def _bodies(met: DataFrame) -> DataFrame:
    """``o, h, begin, stop, cut, body`` of the repeated windows."""
    text = F.col("row.text").cast("binary")
    cut = F.transform("marks", lambda m: F.struct(m["h"].alias("h"), m["begin"].alias("begin"), m["stop"].alias("stop"), m["cut"].alias("cut"), F.substring(text, m["begin"] + 1, m["stop"] - m["begin"]).alias("body")))
    return met.where("marks is not null").select("o", F.inline(cut))


def _told_apart(marks: DataFrame, met: DataFrame, clash: DataFrame) -> DataFrame:
    """``marks`` with the windows of clashing hashes replaced by those whose bytes repeat."""
    rows = _bodies(met).join(clash, "h")
    variants = rows.groupBy("h", "body").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1")
    variants = variants.withColumn("v", F.row_number().over(Window.partitionBy("h").orderBy("body")))
    exact = rows.join(variants, ["h", "body"]).select("o", "begin", "stop", "h", "v", (F.col("o") == F.col("first")).alias("mine"), "cut")
    return marks.join(clash, "h", "left_anti").unionByName(exact)


def _gone(marks: list[dict], size: int) -> list[tuple[int, int]]:
    """(begin, stop) of the runs to remove: windows that aren't first, joined where they meet, if a chunk is among them."""
    out, seen = [], {}
    for x in sorted(marks, key=lambda x: (x["begin"], x["stop"])):
        begin, stop, name = x["begin"], x["stop"], (x["h"], x["v"])
        if not x["mine"] or begin >= seen.get(name, size):
            if out and begin <= out[-1][1] + 1:  # in or next to the run before
                out[-1] = (out[-1][0], max(out[-1][1], stop), out[-1][2] or x["cut"])
            else:
                out.append((begin, stop, x["cut"]))
        seen.setdefault(name, stop + 1)
    return [(a, b) for a, b, cut in out if cut]


def dedup_lines(docs: DataFrame, report: bool = False, hash_bits: int = 64) -> DataFrame:
    """``docs`` without repeated runs of lines, in the same columns; no row goes.

    A chunk goes if it occurs before, in a smaller doc_id or earlier in the text without
    overlap, and with it the rest of its repeated run; a run without a chunk boundary stays (one
    window in eight alone is no chunk, so of runs of two lines an eighth, of four lines one in
    some hundred).  With ``report`` the columns ``_n_lines, _n_removed_lines, _n_removed_chunks`` follow (and replace columns of these
    names); a removed chunk is a maximal removed run.

    Texts are hashed once where they lie.  What moves at first is five values a chunk; windows
    that are none move for documents with a repeated chunk only; then
    each text is sent once to its repeated windows (``_attach``, the same plan at every size)
    and kept in a scratch table, where bytes are compared as the least and the largest body of
    each hash.  Hashes for which they differ, if any, are regrouped by bytes.  ``hash_bits``
    shortens the hash, for tests.

    Null and empty texts stay as they are.  Very long texts are treated whole.  Rows that
    repeat a doc_id but differ in text are documents of their own, in the order of their texts' hashes;
    rows that are equal in both are treated alike, as one document.  Rows without a doc_id come
    after all others.  Ties can't arise: owners differ and windows of one
    text differ in place.  Other columns pass through, whatever their names.  Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    paths: list[str] = []
    seen, at = scratch.save(_occurrences(docs, hash_bits), "windows")
    paths.append(at)
    chunks = seen.where("cut").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    chunks, at = scratch.save(chunks.select("h", "n"), "chunks")
    paths.append(at)
    marked, at = scratch.save(join_keyed(seen.where("cut"), chunks, ["h"], "n").select("o").distinct(), "marked")
    paths.append(at)
    seen, at = scratch.save(seen.join(marked, "o", "left_semi"), "runs")
    paths.append(at)
    again = seen.groupBy("h").agg(F.count("*").alias("n"), F.min("o").alias("first")).where("n > 1")
    again, at = scratch.save(again, "repeated")
    paths.append(at)
    marks = join_keyed(seen, again, ["h"], "n").select("o", "begin", "stop", "h", F.lit(0).alias("v"), (F.col("o") == F.col("first")).alias("mine"), "cut")
    kept: list[str] = []
    met = _attach(docs, marks, kept)
    clash = _bodies(met).groupBy("h").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("h")
    clash, at = scratch.save(clash, "clashing")
    paths.append(at)
    if not clash.isEmpty():
        met = _attach(docs, _told_apart(marks, met, clash), kept)
        paths.append(kept[0])
    scratch.drop(spark, *paths)

    names = [c for c in docs.columns if not (report and c in REPORT)]
    place, text = [docs.columns.index(c) for c in names], docs.columns.index("text")
    out = [*names, *REPORT] if report else names

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.column(0).flatten()
            texts, counts = [], []
            for t, m in zip(fields[text], b.column(1), strict=True):
                old = t.as_py()
                raw = (old or "").encode("utf-8", "surrogatepass")
                kept, lines, gone, at = [], 0, 0, -1
                for begin, stop in _gone(m.as_py() or [], len(raw)):
                    kept.append(raw[max(at, 0) : begin])
                    gone += 1
                    lines += raw.count(b"\n", begin, stop) + 1
                    at = min(stop + 1, len(raw))
                kept.append(raw[max(at, 0) :])
                texts.append(b"".join(kept).decode("utf-8", "surrogatepass") if gone else old)
                counts.append((raw.count(b"\n") + 1 if raw else 0, lines, gone))
            columns = [pa.array(texts, pa.string()) if i == text else fields[i] for i in place]
            if report:
                columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, out)

    schema = docs.select(*[F.col(f"`{c}`") for c in names], *[F.lit(0).cast("long").alias(c) for c in REPORT * report]).schema
    return met.select("row", "marks").mapInArrow(edit, schema)
