"""Suffix-array dedup: repeated 50-byte strings by merging Burrows-Wheeler transforms.

Every 50-byte string has an anchor, the place of the least hash among its 12-byte
substrings, so equal strings have equal anchors.  Neighbouring strings with one anchor
travel together as one fragment of a text; fragments are shuffled by the anchor's hash,
packed and compressed.  So all occurrences of a string meet in one bucket, while a text is
sent about 1.6 times over rather than fifty.

A string reaches 19 bytes or more beyond its anchor on one side, so a fragment can share a
string only with one that has the same 31 bytes to the left or to the right.  Fragments for
which no other document has these need no more, nor do those that all documents have
alike.  Those that several documents of one pack have alike travel once, for the smallest of
them: what the others have is repeated for certain and is flagged before anything is sent, so
a passage in a third of all documents is one fragment a pack and anchor.

The rest are taken in two parts, strings that have the bytes to the left and those that have the
bytes to the right; a part can share a string only with parts of the same 31 bytes, and equal parts
are one.  Groups of such parts, together as many as a core's cache holds, are cut into shards, ranges
of documents; each gets its suffix array and transform.  The transforms are merged by interleave
refinement: the interleave says from which shard each rank comes; a pass reads the shards' transforms
in its order, two symbols at a time, and deals the ranks out by the pair read, stably, after which
they are sorted by two symbols more.  Where neighbours differ in that many symbols is carried along,
so after 25 passes the ranks fall into intervals of suffixes that share 50 bytes, without comparing
or sorting suffixes of different shards.  An interval's smallest doc_id decides which of its strings go.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .skew import join_keyed

LENGTH, GRAM = 50, 12
#: What a string has beyond its anchor on one side at least, and the bytes compared there.
SIDE = (LENGTH - GRAM + 1) // 2
KEY = GRAM + SIDE
#: Text bytes that a task packs at once (places in a pack have 24 bits); symbols per shard.
PACK_BYTES, SHARD = 6_000_000, 1 << 12
#: Starts whose anchors are looked for at once, and symbols whose transforms are merged at once: what a core's cache holds.
BLOCK, MERGED = 1 << 15, 1 << 16
#: Buckets per shuffle partition, and in all at least; a task works on whole buckets, of so many compressed bytes together.
BUCKETS_PER_PARTITION, BUCKETS, WORK_BYTES = 4, 512, 4_000_000
_MUL, _MUL_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)
#: Symbols: bytes and the end.
PAIR = 257
_NO_ID = (1 << 63) - 1
#: First byte of a blob: fragments, or runs that are flagged already.
_FRAGMENTS, _RUNS = b"f", b"r"
_RUN = np.dtype([("doc", "<i8"), ("hash", "<i8"), ("first", "<i8"), ("last", "<i8")])
_HEAD = np.dtype([("doc", "<i8"), ("hash", "<i8"), ("start", "<u4"), ("n", "<u1"), ("anchor", "<u1")])


def _mix(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _MUL


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for i in range(min(8, len(out))):
        out[i::8] = data[i : i + (len(data) - i) // 8 * 8].view("<u8")
    return out


def anchors(data: np.ndarray, first: int = 0) -> np.ndarray:
    """For the string at each start: hash (40 bits) and place (24 bits) of its anchor, the leftmost of equals; ``data`` begins at place ``first``."""
    eight = _words(data)
    h = _mix(eight[:-4] * _MUL + eight[4:] * _MUL_2)  # the twelve bytes
    h ^= h >> np.uint64(32)
    h &= ~_PLACE
    h |= np.arange(first, first + len(h), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def fragments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, strings, anchor) of the fragments of texts that lie one after another in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    begin = np.zeros(len(data) + 1, bool)  # a fragment begins where a text does, or where the anchor is another one
    begin[0] = True
    begin[ends] = True
    starts, found, last = [], [], np.zeros(1, np.uint64)
    for i in range(0, len(data) - LENGTH + 1, BLOCK):
        a = anchors(data[i : i + BLOCK + LENGTH - 1], i)
        new = np.flatnonzero(begin[i : i + len(a)] | (a != np.concatenate((last, a[:-1]))))
        starts.append(new + i)
        found.append(a[new])
        last = a[-1:]
    start, anchor = np.concatenate(starts), np.concatenate(found)
    text = np.searchsorted(ends, start, side="right")
    until = np.minimum(np.append(start[1:], len(data)), ends[text] - LENGTH + 1)  # later strings would leave the text
    whole = until > start
    return text[whole], start[whole], (until - start)[whole], anchor[whole]


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count c."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Rows whose key may occur again; those left out have a key of their own for certain."""
    mask = np.uint64((1 << max(10, int(len(keys) * 6).bit_length())) - 1)
    low = ((keys >> np.uint64(24)) & mask).astype(np.int64)
    return np.flatnonzero(np.bincount(low)[low] > 1) if len(keys) else np.zeros(0, np.int64)


def _numbered(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each piece of ``raw`` among the distinct ones, and these."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
    return ids, list(known)


def _first_holders(raw: bytes, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a fragment's document is the smallest of those that have the same one in ``raw``."""
    stays = np.ones(len(start), bool)
    rows = _repeated(anchor)
    ids, known = _numbered(raw, start[rows], (start + n)[rows] + LENGTH - 1)
    least = np.full(len(known), _NO_ID)
    np.minimum.at(least, ids, doc[rows])
    stays[rows] = doc[rows] == least[ids]
    return stays


def _pack(docs: list[int], hashes: list[int], firsts: list[int], texts: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the fragments of some texts, or parts of texts that begin at ``firsts``."""
    raw = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    text, start, n, anchor = fragments(np.frombuffer(raw, np.uint8), ends)
    if not len(text):
        return
    doc, digest = np.array(docs, np.int64)[text], np.array(hashes, np.int64)[text]
    place = start + (np.array(firsts, np.int64) - np.concatenate(([0], ends[:-1])))[text]
    stays = _first_holders(raw, start, n, anchor, doc)
    pack = zstandard.ZstdCompressor(level=3)
    gone = np.flatnonzero(~stays)
    if len(gone):
        begins = np.concatenate(([True], (text[gone][1:] != text[gone][:-1]) | (start[gone][1:] != (start + n)[gone][:-1])))
        at = np.flatnonzero(begins)
        runs = np.empty(len(at), _RUN)
        runs["doc"], runs["hash"], runs["first"] = doc[gone][at], digest[gone][at], place[gone][at]
        runs["last"] = (place + n - 1)[gone][np.append(at[1:], len(gone)) - 1]
        yield int(runs["first"][0] + len(runs)) % buckets, _RUNS + pack.compress(b"".join(runs[f].tobytes() for f in _RUN.names))
    bucket = ((anchor >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    order = np.flatnonzero(stays)
    order = order[np.argsort(bucket[order], kind="stable")]
    start, n, anchor, bucket = (x[order] for x in (start, n, anchor, bucket))
    head = {
        "doc": doc[order], "hash": digest[order], "start": place[order].astype(np.uint32), "n": n.astype(np.uint8),
        "anchor": ((anchor & _PLACE).astype(np.int64) - start).astype(np.uint8),
    }
    pieces = [raw[a:b] for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        heads = b"".join(head[f][a:b].tobytes() for f in _HEAD.names)
        yield int(bucket[a]), _FRAGMENTS + pack.compress(b"".join((struct.pack("<I", b - a), heads, *pieces[a:b])))


def _unpack_runs(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.int64)
    return list(raw.reshape(len(_RUN.names), -1))


def _unpack(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], bytes]:
    heads: dict[str, list[np.ndarray]] = {f: [] for f in _HEAD.names}
    bodies, unpack = [], zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = unpack.decompress(blob[1:])
        (n,), at = struct.unpack_from("<I", raw), 4
        for f in _HEAD.names:
            heads[f].append(np.frombuffer(raw, _HEAD[f], n, at))
            at += n * _HEAD[f].itemsize
        bodies.append(memoryview(raw)[at:])
    return {f: np.concatenate(x) for f, x in heads.items()}, b"".join(bodies)


def shard_transform(symbols: np.ndarray, is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform, two symbols at a time, of strings that each end in two symbols 0, by doubling ranks.

    Ends count as smaller than all else and differ by string, so suffixes never run into the next string.
    """
    n = len(symbols)
    rank = np.where(is_end, np.cumsum(is_end) - 1, int(is_end.sum()) + symbols.astype(np.int64))
    _, rank = np.unique(rank, return_inverse=True)
    span = 1
    while True:
        further = np.zeros(n, np.int64)
        further[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + further
        order = np.argsort(key)  # equals get one rank
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        span *= 2
    second = np.roll(symbols, 2)  # at a string's first two symbols: an end of the one before, 0
    return order, np.where(second == 0, 0, second * PAIR + np.roll(symbols, 1))[order]


def merge_transforms(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each rank, where a rank differs from the one before in its first ``passes`` pairs of symbols)."""
    sizes = [len(t) for t in transforms]
    ends = np.array([int((t == 0).sum()) for t in transforms])
    number = np.arange(len(transforms), dtype=np.uint8 if len(transforms) <= 1 << 8 else np.uint16 if len(transforms) <= 1 << 16 else np.uint32)
    fixed, shard = np.repeat(number, ends), np.repeat(number, sizes)  # fixed: suffixes that are only ends
    whole = np.concatenate(transforms)
    pairs = np.unique(whole)
    if len(pairs) <= 1 << 16:
        whole = np.searchsorted(pairs, whole).astype(np.uint8 if len(pairs) <= 1 << 8 else np.uint16)
    block = np.zeros(len(shard), np.int32)
    differs = np.zeros(len(shard), bool)
    symbol = np.empty(len(shard), whole.dtype)
    for _ in range(passes):
        symbol[np.argsort(shard, kind="stable")] = whole  # each shard's transform, read in the interleave's order
        dealt = np.argsort(symbol, kind="stable")[len(fixed) :]  # radix sort; ends have no longer suffix
        c, b = symbol[dealt], block[dealt]
        differs[: len(fixed)] = True
        differs[len(fixed)] = True
        differs[len(fixed) + 1 :] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        shard = np.concatenate((fixed, shard[dealt]))
        block = np.cumsum(differs, dtype=np.int32)
    return shard, differs


def least_owner(strings: list[bytes], owner: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string and start, the least owner of any string that contains the ``length`` bytes (an even number) there."""
    sizes = np.array([len(s) for s in strings])
    symbols = np.frombuffer(b"\0\0".join(strings) + b"\0\0", np.uint8).astype(np.int32) + 1
    ends = np.cumsum(sizes + 2) - 1
    symbols[ends] = symbols[ends - 1] = 0
    cut = [0]
    for e in ends.tolist():
        if e + 1 - cut[-1] >= SHARD:
            cut.append(e + 1)
    if cut[-1] != len(symbols):
        cut.append(len(symbols))
    arrays, transforms = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        order, transform = shard_transform(symbols[a:b], symbols[a:b] == 0)
        arrays.append(order + a)
        transforms.append(transform)
    shard, differs = merge_transforms(transforms, length // 2)
    place = np.empty(len(symbols), np.int64)
    place[np.argsort(shard, kind="stable")] = np.concatenate(arrays)  # the suffix of each rank
    least = np.minimum.reduceat(np.repeat(owner, sizes + 2)[place], np.flatnonzero(differs))
    at = np.empty(len(symbols), np.int64)
    at[place] = least[np.cumsum(differs) - 1]
    begin = ends - sizes - 1
    return [at[b : b + n - length + 1] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _side_groups(body: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, group) of the fragments whose ``KEY`` bytes at ``at`` several documents have."""
    eight = np.ndarray((max(0, len(body) - 7),), "<u8", body, strides=(1,))
    key = np.zeros(len(at), np.uint64)
    for i in (0, 8, 16, KEY - 8):
        key = _mix(key * np.uint64(31) + eight[at + i])
    rows = _repeated(key)
    if not len(rows):
        return rows, rows
    rows = rows[np.argsort(key[rows])]
    key, d = key[rows], doc[rows]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    shared = np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)
    group = np.repeat(np.where(shared, np.arange(len(cut)), -1), np.diff(cut, append=len(key)))
    return rows[group >= 0], group[group >= 0]


def _merge_groups(parts: list[bytes], group: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """For each part and start the least owner within its group; groups are merged together up to ``MERGED`` symbols, a larger one alone."""
    out: list[np.ndarray] = [np.full(len(s) - LENGTH + 1, o) for s, o in zip(parts, owner.tolist(), strict=True)]
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1], [True])))
    batch: list[int] = []
    held = 0
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        mine = order[a:b].tolist() if b - a > 1 else []
        size = sum(len(parts[i]) + 2 for i in mine)
        if batch and held + size > MERGED:
            _merge_into(out, parts, owner, batch)
            batch, held = [], 0
        batch += mine
        held += size
    if batch:
        _merge_into(out, parts, owner, batch)
    return out


def _merge_into(out: list[np.ndarray], parts: list[bytes], owner: np.ndarray, batch: list[int]) -> None:
    chosen = np.array(batch)
    chosen = chosen[np.argsort(owner[chosen], kind="stable")]  # shards are ranges of documents
    for i, x in zip(chosen.tolist(), least_owner([parts[i] for i in chosen.tolist()], owner[chosen]), strict=True):
        out[i] = x


def _bucket_rows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, first, last) of the runs of starts whose string is in a smaller document too.

    Strings that begin ``SIDE`` bytes before the anchor or earlier have the left key, the others the
    right one; so a fragment is two parts, and each is compared with those of the same key only.
    """
    head, raw = _unpack(blobs)
    doc, n, anchor = head["doc"], head["n"].astype(np.int64), head["anchor"].astype(np.int64)
    size = n + LENGTH - 1
    at = np.cumsum(size) - size
    body, none = np.frombuffer(raw, np.uint8), np.zeros(0, np.int64)
    rows, firsts, lasts, groups, most = [], [], [], [], 0
    for key, first, last in ((anchor - SIDE, np.zeros_like(n), np.minimum(n - 1, anchor - SIDE)), (anchor, np.maximum(0, anchor - SIDE + 1), n - 1)):
        some = np.flatnonzero(first <= last)
        mine, group = _side_groups(body, (at + key)[some], doc[some])
        mine = some[mine]
        rows.append(mine)
        firsts.append(first[mine])
        lasts.append(last[mine])
        groups.append(group + most)
        most += int(group.max(initial=-1)) + 1
    row, first, last, group = (np.concatenate(x) for x in (rows, firsts, lasts, groups))
    if not len(row):
        return none, none, none, none
    ids, parts = _numbered(raw, at[row] + first, at[row] + last + LENGTH)  # equal parts have one anchor, so one group
    owner, of = np.full(len(parts), _NO_ID), np.empty(len(parts), np.int64)
    np.minimum.at(owner, ids, doc[row])
    of[ids] = group
    least = _merge_groups(parts, of, owner)
    begin = np.cumsum([0, *map(len, least)])[ids]
    least = np.concatenate(least)
    counts = last - first + 1
    inner = _within(counts)
    repeats = least[np.repeat(begin, counts) + inner] < np.repeat(doc[row], counts)
    picked = np.unique(row)
    counts_all = n[picked]
    place = np.cumsum(counts_all) - counts_all
    flagged = np.zeros(int(counts_all.sum()), bool)
    flagged[np.repeat(place[np.searchsorted(picked, row)] + first, counts) + inner] = repeats
    edge = np.zeros(len(flagged) + 1, bool)
    edge[place] = edge[-1] = True
    begins = np.flatnonzero(flagged & (edge[:-1] | ~np.concatenate(([False], flagged[:-1]))))
    ends = np.flatnonzero(flagged & (edge[1:] | ~np.concatenate((flagged[1:], [False]))))
    piece = np.searchsorted(place, begins, side="right") - 1
    q, shift = picked[piece], head["start"][picked[piece]].astype(np.int64) - place[piece]
    return doc[q], head["hash"][q], begins + shift, ends + shift


def repeated_starts(rows: DataFrame) -> DataFrame:
    """``doc, hash, first, last`` of the strings that are in smaller documents too; ``rows``: doc, hash, t (bytes)."""
    buckets = max(BUCKETS, BUCKETS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def out(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in pairs], pa.int32()), pa.array([x for _, x in pairs], pa.binary())], ["bucket", "blob"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, int, bytes]] = []
        size = 0
        for b in batches:
            for d, h, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                text = t.as_py()
                for first in range(0, max(1, len(text) - LENGTH + 1), PACK_BYTES):  # a part holds the strings that start in it
                    parts.append((d.as_py(), h.as_py(), first, text[first : first + PACK_BYTES + LENGTH - 1]))
                    size += len(parts[-1][3])
                    if size >= PACK_BYTES:
                        yield out(list(_pack(*map(list, zip(*parts, strict=True)), buckets)))
                        parts, size = [], 0
        if parts:
            yield out(list(_pack(*map(list, zip(*parts, strict=True)), buckets)))

    def flag(doc, h, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc", "hash", "first", "last"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        bucket, size = None, 0
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != bucket and size >= WORK_BYTES:
                    yield flag(*_bucket_rows(held))
                    held, size = [], 0
                bucket, blob = k, blob.as_py()
                if blob[:1] == _RUNS:
                    yield flag(*_unpack_runs(blob))
                else:
                    held.append(blob)
                    size += len(blob)
        if held:
            yield flag(*_bucket_rows(held))

    packed = rows.select("doc", "hash", "t").mapInArrow(pack, "bucket int, blob binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(find, "doc long, hash long, first int, last int")


def _copies(rows: DataFrame) -> tuple[DataFrame | None, bool]:
    """Rows of ``LENGTH`` bytes or more whose whole text a smaller document has too, and whether no doc_id is on two rows of that length.

    None in place of the rows if they are a third of the bytes at most: setting them aside exchanges all
    texts once more, about as much as the fragments of such a third.
    """
    narrow, path = scratch.save(rows.where(F.octet_length("t") >= LENGTH).select("doc_id", "doc", "hash", F.octet_length("t").cast("long").alias("n_bytes"), F.unhex(F.sha2("t", 256)).alias("digest")), "texts")
    groups = narrow.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    groups, groups_path = scratch.save(groups.where("first < last").select("digest", "first", "n"), "groups")
    copies, copies_path = scratch.save(join_keyed(narrow, groups, ["digest"], "n").where("doc > first").select("doc_id", "doc", "hash", "n_bytes"), "copies")
    n, ids, size = narrow.agg(F.count("doc"), F.countDistinct("doc"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    gone = copies.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    scratch.drop(rows.sparkSession, path, groups_path)
    if 3 * gone > size:
        return copies, n == ids
    scratch.drop(rows.sparkSession, copies_path)
    return None, n == ids


def _merged_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that runs of starts cover, by row and start; runs that touch are one."""
    order = np.argsort((row << 32) | first)
    row, start, end = row[order], first[order], last[order] + LENGTH
    reach = np.maximum.accumulate((row << 32) | end)  # of the row's runs so far
    new = np.concatenate(([True], ((row << 32) | start)[1:] > reach[:-1]))[: len(row)]
    at = np.flatnonzero(new)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1 if len(at) else at] & 0xFFFFFFFF


def suffix_dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` and, if asked for, ``kept`` of every row.

    ``spans`` are the maximal removed runs (start, end in bytes), ``kept`` the bytes that
    stay.  ``doc_id`` is a whole number, as documents are compared by it.  Null and empty texts,
    and those under 50 bytes, lose nothing.  Long texts are packed in parts that overlap, so no
    string is lost.  Rows that repeat a doc_id are judged by their own texts and don't count
    against each other.  A null doc_id counts as larger than all others.  Other columns are
    ignored.  Empty table: no rows.

    Where whole texts of smaller documents are more than a third of the bytes, their rows are set
    aside first: each loses all its bytes, and its strings all are in the smaller document.

    A bucket is worked on by one task.  Equal fragments reach it once a pack; fragments that
    share an anchor and differ beyond it (the edges of a frequent passage) all do, so a bucket
    grows with the number of documents that have one passage in contexts of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("t"))
    scratch.small_batches(docs.sparkSession)
    copies, unique = _copies(rows)
    if copies is not None:
        rows = rows.join(copies.select("doc", "hash"), ["doc", "hash"], "left_anti").select("doc_id", "doc", "hash", "t")
    sent = rows.where(F.octet_length("t") >= LENGTH)
    if unique:  # fragments need no hash to tell rows of one doc_id apart
        sent = sent.withColumn("hash", F.lit(0).cast("long"))
    flags, _ = scratch.save(repeated_starts(sent), "repeats")
    key = ["doc"] if unique else ["doc", "hash"]
    runs = flags.groupBy(key).agg(F.collect_list((F.col("first").cast("long") * (1 << 32)) + F.col("last")).alias("runs"))
    mine = F.when(F.octet_length("t") >= LENGTH, F.col("runs"))  # a shorter text may have the doc_id of another row
    met = rows.join(runs, key, "left").select("doc_id", "t", F.coalesce(mine, F.array().cast("array<long>")).alias("runs"))
    span = "array<struct<start:int,end:int>>"
    schema = met.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lit("").cast("string").alias("kept_sha256"), F.lit(None).cast(span).alias("spans"), *[F.lit(b"").alias("kept")] * keep_text).schema
    span_type = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(2)
            packed = runs.flatten().to_numpy(zero_copy_only=False)
            row, start, end = _merged_runs(np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy())), packed >> 32, packed & 0xFFFFFFFF)
            begin = np.searchsorted(row, np.arange(len(runs) + 1))
            at, starts, ends = begin.tolist(), start.tolist(), end.tolist()
            counts, digests, kept = [], [], []
            for i, t in enumerate(b.column(1)):
                left = raw = t.as_py()
                if at[i] < at[i + 1]:
                    left = b"".join(raw[e:s] for e, s in zip([0, *ends[at[i] : at[i + 1]]], [*starts[at[i] : at[i + 1]], len(raw)], strict=True))
                counts.append((len(raw), len(raw) - len(left)))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(span_type))
            columns = [b.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(2)], pa.array(np.diff(begin)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), spans)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, schema.names)

    out = met.mapInArrow(cut, schema)
    if copies is None:
        return out
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    nothing = hashlib.sha256(b"").hexdigest()
    gone = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), whole.cast(span).alias("spans"), *[F.lit(b"").alias("kept")] * keep_text)
    return out.unionByName(gone)
