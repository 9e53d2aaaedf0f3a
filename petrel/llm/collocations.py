"""Phrase collocations per language, from word-id suffix arrays of shards.

A shard is a few megabytes of whole texts of one task.  Its words become ids, prefix doubling
in numpy sorts the suffixes of the id sequence, and the intervals of their common prefixes are
the shard's n-grams with their counts.  Counts of all shards are added by key.

Phrases occur as often as their rarest part at most, so what can't reach the least count is
left out of the shards' results: a first pass adds up words, the next ones pairs of frequent
words and triples of frequent pairs, the last the longer phrases made of frequent triples.  Each
length is counted in one pass only, by the 64-bit keys of its words, which are salted anew should
any two words share one; texts are looked up for the phrases that stay.  The filters between the
passes are Bloom filters of a fixed size: they let some rare phrases through, whose true count
then decides, and never hold back a frequent one, however many keys they carry.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Words of the longest phrase, least count of a phrase, phrases reported per language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of the longest phrases that have a filter of their own.
FILTERED = 3
#: Bytes of text of a shard (a longer text is a shard of its own), and bits of a Bloom filter.
SHARD, BLOOM_BITS = 6 << 20, 26
#: Phrases of its shards that a task of the last pass holds to add up their counts, about 60 bytes each.
HELD_ROWS = 500_000
_MASK = (1 << BLOOM_BITS) - 1
#: A-Z become small; piece ends become a byte that UTF-8 never has; tabs become spaces.
_END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)


class Shard:
    """Texts of one language as word ids from 1; id 0 ends a piece."""

    def __init__(self, texts: list[bytes]) -> None:
        ids: dict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        ids[_END]
        words = _END.join(texts).translate(_FOLD).replace(_END, b" \xff ").split()
        self.x = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        self.words = list(ids)

    def hashes(self, lang: str, salt: int = 0) -> np.ndarray:
        """64-bit keys of the words; the end's is zero."""
        seed = xxhash.xxh64_intdigest(lang, salt)
        return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in self.words[1:])], np.uint64)


def runs(x: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The ids of the phrases of m words that begin at the (ascending) positions: those at adjacent ones form a run, an end follows each run."""
    if not len(at):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    first, sizes = at[np.append(0, cut)], np.diff(np.concatenate([[0], cut, [len(at)]])) + m
    stop = np.cumsum(sizes)
    out = x[np.minimum(np.arange(stop[-1]) + np.repeat(first - stop + sizes, sizes), len(x) - 1)]
    out[stop - 1] = 0
    return out


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of words in the order of the suffixes that begin there, by their first ``depth`` ids or more: prefix doubling."""
    rank, k = x.astype(np.int64), 1
    while k < depth:
        after = np.zeros(len(x), np.int64)
        after[:-k] = rank[k:] + 1
        rank = rank * (int(after.max(initial=0)) + 1) + after
        k *= 2
        if k < depth:  # dense ranks, so that the next pair fits
            _, rank = np.unique(rank, return_inverse=True)
    starts = np.flatnonzero(x)
    return starts[np.argsort(rank[starts], kind="stable")]


def intervals(x: np.ndarray, order: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, first positions, counts) of the phrases of d words from the sorted suffixes: intervals of common prefixes of d or more."""
    padded = np.concatenate([x, np.zeros(most, x.dtype)])
    same, inside = np.ones(max(len(order) - 1, 0), bool), np.ones(len(order), bool)
    for d in range(1, most + 1):
        at = padded[order + d - 1]
        inside &= at > 0
        same &= at[1:] == at[:-1]
        if d >= least and len(order):
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            counts = np.diff(np.append(begins, len(order)))
            whole = inside[begins]
            yield d, order[begins[whole]], counts[whole]


def keys_of(h: np.ndarray, x: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    """64-bit keys of the phrases of d words that begin at the positions."""
    k = h[x[at]]
    for i in range(1, d):
        k = k * np.uint64(0x9E3779B97F4A7C15) ^ h[x[at + i]]
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(32)
    return k


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``key``: 8 MB whatever the number of keys, merged by OR on the executors before it is fetched."""
    bit = F.explode(F.array(F.col("key").bitwiseAND(_MASK), F.shiftrightunsigned("key", BLOOM_BITS).bitwiseAND(_MASK)))
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def among(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    found = np.ones(len(keys), bool)
    for shift in (0, BLOOM_BITS):
        bit = (keys >> np.uint64(shift)) & np.uint64(_MASK)
        found &= (filled[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
    return found


def added_up(parts: Iterator[pa.RecordBatch], held_rows: int) -> Iterator[pa.RecordBatch]:
    """The parts with ``n`` summed over equal rows, as far as ``held_rows`` rows reach; nothing is left out."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def merged() -> pa.Table:
        table = pa.Table.from_batches(held)
        names = [c for c in table.column_names if c != "n"]
        return table.group_by(names).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(table.column_names).combine_chunks()

    for part in parts:
        held.append(part)
        rows += len(part)
        if rows > held_rows:
            whole = merged()
            held, rows = whole.to_batches(), len(whole)
            if 2 * rows > held_rows:  # little was equal
                yield from held
                held, rows = [], 0
    if held:
        yield from merged().to_batches()


def _by_shard(rows: DataFrame, count: Callable[[str, Shard], pa.RecordBatch], schema: str, held_rows: int = 0) -> DataFrame:
    """``count`` of every shard and language of ``lang, text``; a task adds up its shards' counts if it may hold rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = counted(batches)
        yield from added_up(parts, held_rows) if held_rows else parts

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                held[lang.as_py()].append(t := text.as_buffer().to_pybytes())
                size += len(t)
                if size >= SHARD:
                    yield from (count(k, Shard(v)) for k, v in held.items())
                    held.clear()
                    size = 0
        yield from (count(k, Shard(v)) for k, v in held.items())

    return rows.mapInArrow(run, schema)


def _starts(shard: Shard, h: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    """Positions at which a phrase of as many words as there are filters begins, all parts of which may be frequent."""
    good = among(filters[0], h)
    good[0] = False
    at = np.flatnonzero(good[shard.x])
    for d, filled in enumerate(filters[1:], 2):
        at = at[:-1][np.diff(at) == 1]  # the part one word later may be frequent too
        at = at[among(filled, keys_of(h, shard.x, at, d))]
    return at


def _words(salt: int) -> Callable[[str, Shard], pa.RecordBatch]:
    """Counts of all words, with their keys."""

    def count(lang: str, shard: Shard) -> pa.RecordBatch:
        n = np.bincount(shard.x, minlength=len(shard.words))[1:]
        names = ["lang", "phrase", "n", "key"]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(shard.words[1:], pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(shard.hashes(lang, salt)[1:].view(np.int64))], names)

    return count


def _phrases(filters: list[np.ndarray], most: int, salt: int) -> Callable[[str, Shard], pa.RecordBatch]:
    """Counts of the phrases longer than the last filter's, up to ``most`` words, by the keys of their words; zeros follow the last word's."""
    m = len(filters)

    def count(lang: str, shard: Shard) -> pa.RecordBatch:
        h = shard.hashes(lang, salt)
        y = runs(shard.x, _starts(shard, h, filters), m)
        keys, counts = [np.zeros((0, most), np.uint64)], [np.zeros(0, np.int64)]
        for d, first, n in intervals(y, suffix_array(y, most), m + 1, most):
            keys.append(np.zeros((len(first), most), np.uint64))
            keys[-1][:, :d] = h[y[first[:, None] + np.arange(d)]]
            counts.append(n)
        keys = np.concatenate(keys).view(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(keys[:, i])) for i in range(most)), pa.array(np.concatenate(counts), pa.int64())], [*_keys(most), "n"])

    return count


def _keys(d: int) -> list[str]:
    return [f"k{i}" for i in range(1, d + 1)]


def shared_keys(words: DataFrame) -> bool:
    """Whether two words share a key, or one has the end's."""
    return not words.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or key = 0").isEmpty()


def _joined(phrases: DataFrame, d: int) -> DataFrame:
    """``key`` of each phrase of d words, as ``keys_of`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).view(np.uint64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(h, np.arange(len(h)), np.arange(0, len(h), d), d).view(np.int64))], ["key"])

    return phrases.select(*_keys(d)).mapInArrow(run, "key long")


def _spelt(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase, words, f`` of ``keys, f``: each key is one word's."""
    parts = phrases.select("keys", "f", F.posexplode("keys").alias("at", "key")).join(words.select("key", "lang", "phrase"), "key")
    parts = parts.groupBy("keys", "f").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "phrase"))).alias("parts"))  # as many as the phrase has words
    return parts.select("lang", F.array_join("parts.phrase", " ").alias("phrase"), F.size("keys").alias("words"), "f")


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, list[str]]:
    """All words, and all phrases of 2 to ``longest`` words with ``least`` occurrences or more: saved tables ``lang, phrase, words, f``; their paths."""
    scratch.small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for salt in numbers():
        totals = _by_shard(rows, _words(salt), "lang string, phrase string, n long, key long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("key").alias("key"))
        words, words_at = scratch.save(totals.withColumn("words", F.lit(1)), "words")
        if not shared_keys(words):
            break
        scratch.drop(docs.sparkSession, words_at)
    often = words.where(F.col("f") >= least)
    filters, found, keyed = [bloom(often.select("key"))], [], []
    while len(filters) < longest:
        d = len(filters) + 1
        most = d if d <= FILTERED else longest
        schema = ", ".join(f"{c} long" for c in [*_keys(most), "n"])
        counted = _by_shard(rows, _phrases(list(filters), most, salt), schema, HELD_ROWS if d > FILTERED else 0)
        counted = counted.groupBy(*_keys(most)).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        counted, at = scratch.save(counted, "keyed")
        keyed.append(at)
        found.append(counted.select(F.array_remove(F.array(*_keys(most)), F.lit(0).cast("long")).alias("keys"), "f"))
        if most == longest:
            break
        filters.append(bloom(_joined(counted, d)))
    grams, grams_at = scratch.save(_spelt(reduce(DataFrame.unionAll, found), often), "phrases")
    scratch.drop(docs.sparkSession, *keyed)
    return words.select("lang", "phrase", "words", "f"), grams, [words_at, grams_at]


def _part(phrase: str, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, top: int | None = TOP, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language, all of them if ``top`` is None.

    Phrases have 2 to ``longest`` words inside a piece and a >= ``least`` occurrences.  A cut
    gives l and r, the counts of both parts, and floor(1000 a n / (l r)), n being all words of
    the language; the lowest value is the score, the first such cut counts.  A phrase
    inside a longer one that occurs as often is left out; as counts only shrink with length,
    it is enough to look one word further.

    Null texts are empty; null languages are ``und``.  Long texts are counted whole.  Repeated
    rows count each.  Equal scores go by a, then by the phrase's bytes, so ranks are total.
    Products take 38 digits, enough for 10^13 words.  Other columns are ignored.  Empty table: no rows.
    """
    words, grams, paths = frequent(docs, least, longest)
    counts = words.where(F.col("f") >= least).select("lang", "phrase", "f").unionByName(grams.select("lang", "phrase", "f"))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    k = F.col("k")
    cuts = grams.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _part("phrase", F.lit(1), k), "right": _part("phrase", k + 1, F.col("words") - k)})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))  # longest - 1 at most
    inside = grams.where("words > 2").select("lang", F.explode(F.array(_part("phrase", F.lit(1), F.col("words") - 1), _part("phrase", F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("f").alias("a"))
    stay = cuts.join(inside, ["lang", "phrase", "a"], "left_anti").join(totals, "lang")
    big = lambda c: c.cast("decimal(19,0)")
    value = lambda x: F.call_function("div", big(F.col("a")) * big(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), big(x["l"]) * big(x["r"]))
    best = F.array_min(F.transform("cuts", lambda x: F.struct(value(x).alias("score"), x["k"].alias("k"), x["l"].alias("l"), x["r"].alias("r"))))
    out = stay.withColumn("best", best).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
