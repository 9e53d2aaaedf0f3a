"""SimHash near-dedup with Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect binary
Golay code (23, 12) puts every 23-bit word within 3 bits of exactly one codeword; a
segment's keys are the codewords nearest to it and to its 23 one-bit neighbours, one or
six of them.  Two segments that differ in two bits or fewer share a key, since a word
half way decodes for both.  Three differing bits fall on the segments in one of these ways
(e1, e2, e3 of them), and each family of keys meets all pairs of its case:

* A, e3 <= 1 and e1, e2 <= 2: a Golay key of both long segments and half of the short one;
* B, e3 >= 2, so e1 + e2 <= 1: one long segment as it is and a Golay key of the other;
* C, e1 = 3 or e2 = 3: the other long segment and the short one as they are.

That is 5 to 76 keys of 33 to 41 bits.  Rows that share a key are verified bit by bit.
A key held by more than ``CROWD`` fingerprints is not paired: its fingerprints get finer keys
instead (any 9 of 12 parts equal, then any 21 of 24), and where those are crowded too, all
words but three bits, which eight fingerprints at most can share.  So no pair is lost and none of the
stages makes more rows than its keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
#: A key's fingerprints are compared directly up to this number.
CROWD = 24
#: The pipeline's stage has its own: words of a shingle, percent of Jaccard similarity, fingerprints, nodes that a task remembers.
STAGE_WORDS, STAGE_PERCENT, STAGE_PRINTS, STAGE_MEMO = 5, 80, 4, 200_000
#: Bits of a set's parity sketch; nodes of a key that are compared in one task, larger keys are split without loss.
PARITY_BITS, STAGE_CROWD = 1024, 4096
#: Parts into which finer keys cut a fingerprint, by level; three of them are hidden.
LEVEL_PARTS = (0, 12, 24, 64)
#: Generator polynomial of the Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: bytes, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bits set in more than half of the hashes of the word k-grams (repeats count); no word: 0."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - k + 1)
    last = (ends[k - 1 :] if len(words) >= k else ends[-1:]) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(whole[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # very long texts in blocks
        counts += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row; null text counts as empty."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def _syndrome_bits(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits; per syndrome the changes that lead to its keys, and how many they are."""
    upper = np.array([_syndrome_bits(x << 11) for x in range(4096)], np.int64)
    leader = np.zeros(2048, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            leader[_syndrome_bits(e)] = e
    near = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    steps = [0] + [1 << b for b in range(23)]
    for s in range(2048):
        changes = sorted({u ^ int(leader[s ^ _syndrome_bits(u)]) for u in steps})
        near[s, : len(changes)], count[s] = changes, len(changes)
    return upper, near, count


def golay_keys(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: indices (12 bits) of the nearby codewords, n x 6, and which of the six are real."""
    upper, near, count = tables
    s = upper[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ near[s]) >> 11, np.arange(6)[None, :] < count[s][:, None]


def segment_keys(fp: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, family, key) of the families A to C for unsigned fingerprints."""
    s1, s2, s3 = ((fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in ((41, 23), (18, 23), (0, 18)))
    (g1, ok1), (g2, ok2) = golay_keys(s1, tables), golay_keys(s2, tables)
    row, out = np.arange(len(fp)), []
    for half, part in enumerate((s3 >> 9, s3 & 511)):
        key = (g1[:, :, None] << 21) | (g2[:, None, :] << 9) | part[:, None, None]
        ok = ok1[:, :, None] & ok2[:, None, :]
        out.append((np.broadcast_to(row[:, None, None], ok.shape)[ok], half, key[ok]))
    for family, exact, g, ok in ((2, s1, g2, ok2), (3, s2, g1, ok1)):
        out.append((np.broadcast_to(row[:, None], ok.shape)[ok], family, ((exact[:, None] << 12) | g)[ok]))
    out += [(row, 4, (s2 << 18) | s3), (row, 5, (s1 << 18) | s3)]
    return tuple(np.concatenate(x) for x in ([r for r, _, _ in out], [np.full(len(r), f) for r, f, _ in out], [k for _, _, k in out]))


def masks(parts: int) -> np.ndarray:
    """All words that hide 3 of so many parts of the 64 bits; parts = 64 hides any three bits."""
    edge = np.linspace(0, 64, parts + 1).round().astype(int)
    part = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edge, edge[1:], strict=False)]
    every = (1 << 64) - 1
    return np.array([every ^ sum(c) for c in combinations(part, 3)], np.uint64)


_KEYS = "family int, key long, fp long"


def _key_rows(fps: DataFrame, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables() if level == 0 else None
        hide = masks(LEVEL_PARTS[level]) if level else None
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            step = 8192 if level == 0 else max(1, 400_000 // len(hide))
            for i in range(0, len(every), step):
                fp = every[i : i + step]
                if level == 0:
                    row, family, key = segment_keys(fp, tables)
                else:
                    row = np.repeat(np.arange(len(fp)), len(hide))
                    family = np.tile(np.arange(len(hide)), len(fp))
                    key = (fp[:, None] & hide[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(family.astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(fp[row].view(np.int64))], ["family", "key", "fp"])

    return fps.select("fp").mapInArrow(run, _KEYS)


def _near_pairs(fp: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Links of sorted rows with their later neighbours in the same run (``end`` of each row's run), as a forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at, links = np.arange(len(fp)), []
    for o in range(1, CROWD):
        i = at[at + o < end]
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + o]) <= MAX_BITS]
        for a, b in zip(fp[i].tolist(), fp[i + o].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[rb] = ra
                links.append((a, b))
    return links


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by family and key: ``a, b`` linked fingerprints; ``a, null`` those of a crowded key."""
    held: tuple[np.ndarray, ...] | None = None
    crowded: tuple[int, int] | None = None

    def out(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def ended(family: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((family[1:] != family[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
        size = np.repeat(ends - starts, ends - starts)
        end = np.repeat(ends, ends - starts)
        many = size > CROWD
        if many.any():
            each = np.unique(fp[many])
            yield out(each.view(np.int64), [None] * len(each))
        links = _near_pairs(fp, np.where(many, 0, end))
        if links:
            ab = np.array(links, np.uint64)
            yield out(ab[:, 0].copy().view(np.int64), ab[:, 1].copy().view(np.int64))

    for b in batches:
        family, key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        if not len(fp):
            continue
        if crowded is not None:
            n = int(np.argmin(np.append((family == crowded[0]) & (key == crowded[1]), False)))
            if n:
                each = np.unique(fp[:n])
                yield out(each.view(np.int64), [None] * len(each))
            family, key, fp = family[n:], key[n:], fp[n:]
            if not len(fp):
                continue
            crowded = None
        if held is not None:
            family, key, fp = (np.concatenate(x) for x in zip(held, (family, key, fp), strict=True))
        same = (family == family[-1]) & (key == key[-1])
        first = len(fp) - int(np.argmin(np.append(same[::-1], False)))
        if first:
            yield from ended(family[:first], key[:first], fp[:first])
        held = (family[first:], key[first:], fp[first:])
        if len(held[2]) > CROWD:  # its length is known to be too much; later rows of it need not be held
            yield from ended(*held)
            crowded, held = (int(family[-1]), int(key[-1])), None
    if held is not None:
        yield from ended(*held)


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect exactly those within 3 bits."""
    spark = fps.sparkSession
    links, members = None, fps
    for level in range(len(LEVEL_PARTS)):
        rows = _key_rows(members, level).repartition("family", "key").sortWithinPartitions("family", "key")
        found, _ = scratch.save(rows.mapInArrow(_link_runs, "a long, b long"), f"links{level}")
        fine = found.where("b is not null").distinct()
        links = fine if links is None else links.unionByName(fine)
        members = found.where("b is null").select(F.col("a").alias("fp")).distinct()
        if members.isEmpty():
            break
    return links


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the fingerprint and the smallest doc_id reachable by links.

    Fingerprints are collapsed before any pairing, so exact copies, however many, are one
    node.  Null, empty and blank texts have fingerprint 0 and are linked like others.  Rows
    that repeat a doc_id are nodes by their own text.  Null doc_ids never name a component
    unless all of its ids are null.  Empty table: no rows.
    """
    scratch.small_batches(docs.sparkSession)
    fp, _ = scratch.save(fingerprints(docs), "fingerprints")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(near_links(nodes.select("fp")), "a", "b").withColumnsRenamed({"node": "fp", "component": "part"})
    nodes, _ = scratch.save(nodes.join(parts, "fp", "left").withColumn("part", F.coalesce("part", "fp")), "nodes")
    least = nodes.groupBy("part").agg(F.min("least").alias("component_id"))
    return fp.join(nodes.join(least, "part").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def owner(doc_id: Column, text: Column) -> Column:
    """A row by its doc_id (a null comes last) and a hash of its text; only rows that are equal in both share it."""
    return F.struct(doc_id.isNull().alias("late"), doc_id.alias("id"), F.xxhash64(text).alias("k"))


def _owned(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(owner(F.col("doc_id"), text).alias("o"), text.cast("binary").alias("t"))


def _keep(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows of owners ``dropped``; of rows with one owner, one stays. Texts are shuffled once."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), owner(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))).alias("o"))
    rows = rows.join(dropped.hint("merge"), "o", "left_anti")  # the same plan at every size
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("o").orderBy("o"))).where("n = 1")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def shingles(text: bytes, k: int = STAGE_WORDS) -> tuple[int, np.ndarray]:
    """Hash of the words as a signed long, and the sorted distinct hashes of the word k-grams (fewer words: one of all)."""
    words = text.lower().split()
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), ends))[: max(1, len(words) - k + 1) if words else 0].tolist()
    last = ((ends[k - 1 :] if len(words) >= k else ends[-1:]) - 1).tolist()
    h = xxhash.xxh64_intdigest
    each = {h(whole[a:b], SEED) for a, b in zip(starts, last, strict=True)}
    return h(whole, SEED + 1) - (1 << 63), np.sort(np.fromiter(each, np.uint64, len(each)))


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Another hash of each hash, by number n."""
    x = (h ^ np.uint64(0xD1B54A32D192ED03 * (n + 1) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def stage_keys(h: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys of a set of shingles: per long segment of each fingerprint its Golay keys, each with a least shingle."""
    out = []
    for f in range(STAGE_PRINTS):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), 65536):
            bits = _mixed(h[i : i + 65536], f).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
        fp = int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")
        for half, shift in enumerate((41, 18)):
            near, real = golay_keys(np.array([fp >> shift & (1 << 23) - 1]), tables)
            table = 2 * f + half
            least = _mixed(h, STAGE_PRINTS + table).min()
            out.append(_mixed(least ^ near[real].astype(np.uint64), table))
    return np.concatenate(out)


def short_hashes(h: np.ndarray) -> np.ndarray:
    """The set of 32-bit hashes by which sets of shingles are compared."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def parity(h: np.ndarray) -> np.ndarray:
    """Bits (as longs) that are set where an odd number of the hashes falls: sets that differ in n hashes differ in n bits at most."""
    odd = np.bincount(h % np.uint32(PARITY_BITS), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """``o, node, keys, n, bits`` of every row: shingles and their parity; a task gives the keys of a node once, as long as it remembers it, and no keys to texts without words."""
    rows = _owned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = golay_tables(), set()
        for b in batches:
            nodes, keys, sizes, bits = [], [], [], []
            for t in b.column(1):
                node, h = shingles(t.as_py())
                fresh = len(h) and node not in known
                short = short_hashes(h) if fresh else None
                nodes.append(node)
                keys.append(stage_keys(h, tables).view(np.int64) if fresh else None)
                sizes.append(len(short) if fresh else None)
                bits.append(parity(short) if fresh else None)
                known.add(node)
            if len(known) > STAGE_MEMO:
                known = set()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(keys, longs), pa.array(sizes, pa.int64()), pa.array(bits, longs)], ["o", "node", "keys", "n", "bits"])

    none = F.lit(None)
    return rows.mapInArrow(run, rows.select("o", F.lit(0).cast("long").alias("node"), none.cast("array<long>").alias("keys"), none.cast("long").alias("n"), none.cast("array<long>").alias("bits")).schema)


def _sharing(keys: DataFrame) -> DataFrame:
    """Distinct nodes of ``key, node`` that share a key with another node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 2
        for b in batches:
            key, node = (np.concatenate((x, b.column(i).to_numpy(zero_copy_only=False))) for i, x in enumerate(last))
            i = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate((node[i], node[i + 1]))))], ["node"])
            last = [key[-1:], node[-1:]]

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "node long").distinct()


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ, row by row: a lower bound of the shingles that only one of the two has."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it would count the absolute value


def _meetings(rows: DataFrame, forest: bool) -> DataFrame:
    """Distinct pairs ``a < b`` of nodes of ``key, node, part, n, bits`` that share a key but no part and may have the similarity.

    All pairs of a key are compared where they lie. Similar sets differ in at most a ninth of their shingles together (at 80 %), so a
    pair with more differing bits can't be similar; no other is left out.  ``forest``: per key only pairs that link what earlier ones
    have not, likely ones first; every node that has a pair is in one of these.
    """
    share = (100 - STAGE_PERCENT) / (100 + STAGE_PERCENT)

    def pairs(node: np.ndarray, part: np.ndarray, n: np.ndarray, bits: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.arange(len(node))

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        for likely in (True, False) if forest else (False,):
            at = np.arange(len(node))
            for o in range(1, len(node)):
                at = at[at + o < end[at]]
                if not len(at):
                    break
                i = at[(part[at] != part[at + o]) & (group[at] != group[at + o])]
                most = (n[i] + n[i + o]) * share
                i, most = (x[np.abs(n[i] - n[i + o]) <= most] for x in (i, most))
                if likely:  # as many bits as that many shingles change on average
                    most = PARITY_BITS / 2 * -np.expm1(-2 * most / PARITY_BITS)
                i = i[_differing(bits[i], bits[i + o]) <= most + 1e-6]
                if forest and len(i):
                    new = []
                    for x in i.tolist():
                        if (rx := root(x)) != (ry := root(x + o)):
                            group[ry] = rx
                            new.append(x)
                    i = np.array(new, np.int64)
                    while (group != group[group]).any():
                        group = group[group]
                if len(i):
                    x, y = node[i], node[i + o]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def ended(key: np.ndarray, node: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # a node that several tasks gave
        key, node, *rest = (x[once] for x in (key, node, *rest))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        yield from pairs(node, *rest, np.repeat(starts + sizes, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not len(b):
                continue
            now = (*(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)), b.column(4).flatten().to_numpy().reshape(len(b), -1))
            first = int(np.argmax(now[0] == now[0][-1]))  # where the last key begins
            if held and (first or held[0][0][0] != now[0][0]):
                yield from ended(*(np.concatenate(x) for x in zip(*held, tuple(x[:first] for x in now), strict=True)))
                held = []
            elif first:
                yield from ended(*(x[:first] for x in now))
            held.append(tuple(x[first:] for x in now))
        if held:
            yield from ended(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = rows.select("key", "node", "part", "n", "bits").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _uncrowded(docs: DataFrame, rows: DataFrame, holders: DataFrame, crowd: int) -> DataFrame:
    """``rows`` (``key, node`` and more) with finer keys instead of those of more than ``crowd`` nodes, such that similar nodes of a key share one of its finer ones.

    First a key with one of a text's rarest shingles: of n shingles, similar texts share n * 80 % or more, so at least one of the n * 20 % + 1
    rarest. A finer key that is crowded too is dealt in blocks, and every two of its blocks meet.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > crowd)
    counts, path = scratch.save(counts, "crowds")
    if counts.isEmpty():
        scratch.drop(rows.sparkSession, path)
        return rows
    calm = rows.join(counts, "key", "left_anti")
    many = rows.join(counts.drop("size"), "key")
    nodes = many.select("node").distinct()
    sets, _ = scratch.save(_shingle_sets(docs, holders.join(nodes, "node", "left_semi")), "crowd_sets")
    each = sets.select("node", F.explode("h").alias("h"))
    order = F.array_sort(F.collect_list(F.struct("held", "h")))
    rare = each.join(each.groupBy("h").agg(F.count("*").alias("held")), "h").groupBy("node").agg(order.alias("h"))
    first = F.size("h") - F.ceil(F.size("h") * F.lit(STAGE_PERCENT) / 100).cast("int") + 1
    rare, _ = scratch.save(rare.select("node", F.slice("h.h", F.lit(1), first).alias("rare")), "rare")
    finer = many.join(rare, "node").withColumn("key", F.explode(F.transform("rare", lambda x: F.xxhash64("key", x)))).drop("rare")
    finer, _ = scratch.save(finer, "finer")
    counts = finer.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > crowd)
    counts, _ = scratch.save(counts, "crowds")
    blocks = F.ceil(F.col("size") * 4 / F.lit(crowd)).cast("long")
    dealt = finer.join(counts.withColumn("blocks", blocks).drop("size"), "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    dealt = dealt.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    names = rows.columns
    return calm.select(names).unionByName(finer.join(counts, "key", "left_anti").select(names)).unionByName(dealt.select(names))


def _shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, h`` (sorted 32-bit shingle hashes) of the nodes given, from one text each: ``nodes`` has ``o, node``. Texts are shuffled once."""
    rows = _owned(docs).join(nodes.hint("merge"), "o").select("node", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [short_hashes(shingles(t.as_py())[1]).view(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], ["node", "h"])

    return rows.mapInArrow(run, "node long, h array<int>").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have the similarity."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "h": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "h": "y"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (s.values.to_numpy() for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= STAGE_PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``o, keep`` of every row: its owner (``owner``) and that of the group's first row, linked where the sets of five-word shingles are similar to 0.8 or more.

    Candidates share a key: a Golay key of a 23-bit segment of one of several SimHash
    fingerprints, together with the least shingle under that segment's own order, which keeps
    keys apart at any corpus size.  Each of the eight segments meets a pair at 0.8 in about 0.4
    of cases (more above it).  All pairs of a key are candidates, however many nodes it has
    (``_uncrowded`` splits large keys without loss), unless their parity bits rule the similarity
    out; every candidate is verified on its whole shingle sets, as 32-bit hashes.

    A first pass verifies per key the pairs that would link it, the second one all pairs that
    are still apart after that.

    Texts of the same words (A-Z folded) are one node; those without words are one too.  Rows
    that repeat a doc_id are judged by their own texts.  Null doc_ids come last.  Empty table:
    no rows.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    made: list[str] = []

    def saved(df: DataFrame, name: str) -> DataFrame:
        df, path = scratch.save(df, name)
        made.append(path)
        return df

    rows = saved(_sketches(docs), "sketches")
    keys = rows.where("keys is not null").select("node", "keys", "n", "bits")
    ends = saved(_sharing(keys.select(F.explode("keys").alias("key"), "node")), "ends")
    holders = rows.join(ends, "node", "left_semi").groupBy("node").agg(F.min("o").alias("o"))
    some = keys.join(ends, "node", "left_semi").select(F.explode("keys").alias("key"), "node", "n", "bits")
    some = _uncrowded(docs, some, holders, STAGE_CROWD)
    near = saved(_meetings(some.withColumn("part", F.col("node")), True), "near")
    met = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = saved(_shingle_sets(docs, holders.join(met, "node", "left_semi")), "sets")
    links = saved(_similar(near, sets), "links")
    parts = saved(connected_components(links, "a", "b").withColumnRenamed("component", "part"), "parts")
    apart = some.join(met, "node", "left_semi").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    pairs = saved(_meetings(apart, False).join(near, ["a", "b"], "left_anti"), "pairs")  # linked ones need not meet again
    links = saved(links.unionByName(_similar(pairs, sets)), "links")
    parts = saved(connected_components(links, "a", "b").withColumnRenamed("component", "part"), "parts")
    nodes = rows.groupBy("node").agg(F.min("o").alias("least")).join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    nodes = saved(nodes, "nodes")
    least = nodes.groupBy("part").agg(F.min("least").alias("keep"))
    least = saved(nodes.join(least, "part").select("node", "keep"), "least")
    groups, _ = scratch.save(rows.select("o", "node").join(least, "node").select("o", "keep"), "groups")
    scratch.drop(spark, *made)
    return groups


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """The first row (smallest doc_id, then hash of its text) of each group of similar texts (``similar_groups``), with its columns, whatever their names."""
    return _keep(docs, similar_groups(docs).where("o <> keep").select("o").distinct())
