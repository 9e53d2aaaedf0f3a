"""A trie of conversations over their turns: which prefixes are shared, by whom, and what sharing saves.

Turns travel as digests.  A prefix is named by its depth and a 128-bit hash, the XOR of hashes
of (place, digest), so a conversation's prefixes are a running aggregate and the members of
each node are counted before any shuffle; copies of a conversation are one path from there on.
Nodes of one conversation are settled by that.  The shared ones form chains in which nothing
branches or ends; a chain is one entry of the trie.

Chains are partitioned by the digest of the first turn, or rather of the first turn at which
conversations differ at all, and several first turns share a bucket by hash.  Inside a bucket
a trie of pointers is built in a dictionary and folded in postorder with a stack.  A first
turn with more than ``SUBTRIE`` chains is not one group: its top chain is set aside and the
rest is partitioned again by the next turn below it, as often as needed; the chains set aside
are then added up from their children's totals, from the last round to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .skew import join_keyed

#: A subtrie of more chains is partitioned by its next turn; a bucket of subtries has about so many.
SUBTRIE = 20_000
#: Turns of a conversation that meet in one group; longer ones are blocks with totals.
BLOCK = 4096
KEY = ["pos", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(convs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """``c, k, d, size`` of every turn, k from 1 in the order of the conversation, and ``c, n``; paths of their tables.

    Turns are ordered by turn (null first), ties by digest.  They are dealt by ranges of that
    order, so a conversation of any length is split; equal rows are split by their place in the input.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.length(text).cast("long").alias("size"))
    order = [F.col("c"), F.asc_nulls_first("turn"), F.col("d")]
    rows = rows.withColumn("i", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("i")).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, upto = TaskContext.get().partitionId(), None, 0
        for b in batches:
            c = b.column(0).to_numpy()
            if not len(c):
                continue
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            k = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
            head = len(c) if len(first) == 1 else first[1]
            if c[0] == last:
                k[:head] += upto
            last, upto = c[-1], int(k[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(c), part, np.int32)), pa.array(k, pa.int64()), b.column(1), b.column(2)], ["c", "p", "k", "d", "size"])

    found, at = scratch.save(rows.select("c", "d", "size").mapInArrow(number, "c long, p int, k long, d binary, size long"), "turns")
    pieces = found.groupBy("c", "p").agg((F.max("k") + 1).alias("n")).groupBy("c").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "n"))).alias("pieces"))
    pieces, pieces_at = scratch.save(pieces, "conversations")
    # a range has two conversations at most that go on in another one, so these rows are bounded by the partitions
    later = pieces.where(F.size("pieces") > 1).select("c", F.posexplode("pieces").alias("i", "x"), "pieces")
    later = later.select("c", F.col("x.p").alias("p"), F.aggregate(F.slice("pieces", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("before"))
    turns = found.join(F.broadcast(later), ["c", "p"], "left").select("c", (F.col("k") + F.coalesce("before", F.lit(0)) + 1).alias("k"), "d", "size")
    return turns, pieces.select("c", "n"), [at, pieces_at]


def rebuilt(convs: DataFrame, heads: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame, list[str]]:
    """``c, pos, t, d, size``: each conversation with its first h turns replaced by those of its family's first, t turns in all; and ``c, t``.

    h is the CRC-32 of the decimal id modulo ``heads``, the family's first is c - c % ``family``
    (% as in SQL).  Without that conversation nothing replaces the turns; a shorter one gives all it has.
    """
    turns, counts, paths = numbered(convs)
    base = F.col("c") - F.col("c") % family
    counts = counts.withColumns({"h": F.crc32(F.col("c").cast("string").cast("binary")) % heads, "base": base})
    of_base = counts.where("c = base").select("base", F.col("n").alias("base_n"))
    counts = counts.join(of_base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    counts = counts.withColumn("t", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("c", "base", "n", "h", "m", "t")
    counts, at = scratch.save(counts, "lengths")
    block = F.floor((F.col("k") - 1) / BLOCK)
    blocks = counts.where("n > h").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    own = turns.withColumn("block", block).join(blocks, ["c", "block"]).where("k > h").select("c", (F.col("k") - F.col("h") + F.col("m")).alias("pos"), "t", "d", "size")
    first = turns.where((F.col("c") % family == 0) & (F.col("k") < heads)).select(F.col("c").alias("base"), "k", "d", "size")
    taken = counts.where("m > 0").join(first, "base").where("k <= m").select("c", F.col("k").alias("pos"), "t", "d", "size")
    return own.unionByName(taken), counts.select("c", "t"), [*paths, at]


def _paths(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with the prefix up to each turn: ``p1, p2`` its hash, ``q1, q2`` its parent's, ``s`` its code points."""
    h = {"h1": F.xxhash64("pos", "d"), "h2": F.xxhash64("d", "pos", F.lit(7))}
    rows = rows.withColumns(h | {"block": F.floor((F.col("pos") - 1) / BLOCK)}).select("c", "pos", "t", "size", "block", "h1", "h2")
    upto = Window.partitionBy("c", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"p1": F.bit_xor("h1").over(upto), "p2": F.bit_xor("h2").over(upto), "s": F.sum("size").over(upto)})
    rows, at = scratch.save(rows, "prefixes")
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where(F.col("t") > BLOCK).groupBy("c", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.sum("size").alias("bs"))
    totals = totals.select("c", "block", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2"), F.sum("bs").over(before).alias("bs"))
    late = rows.where("block > 0").join(totals, ["c", "block"])
    late = late.withColumns({"p1": F.col("p1").bitwiseXOR(F.col("b1")), "p2": F.col("p2").bitwiseXOR(F.col("b2")), "s": F.col("s") + F.col("bs")}).drop("b1", "b2", "bs")
    whole = rows.where("block = 0").unionByName(late)
    return whole.withColumns({"q1": F.col("p1").bitwiseXOR(F.col("h1")), "q2": F.col("p2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2", "block"), [at]


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids per node, fed id by id: no group is held, though a group's ids pass one task, as the hash demands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        names = [*KEY, "ends_sha256"]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in done], pa.int64()) for i in range(3)), pa.array([x[3] for x in done], pa.string())], names)

        for b in batches:
            for *k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k == key:
                    sha.update(b",%d" % c)
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(b"%d" % c)
            if len(done) >= 10_000:
                yield batch()
                done.clear()
        if key:
            done.append((*key, sha.hexdigest()))
        yield batch()

    return rows.select(*KEY, "c").repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInArrow(run, "pos long, p1 long, p2 long, ends_sha256 string")


CHAIN = "c long, n long, d1 long, s1 long, leaves long, below long, total long, up long, q1 long, q2 long"


def fold(chains: pd.DataFrame) -> pd.DataFrame:
    """Leaves and savings of the chains of a bucket, from a trie of pointers folded in postorder; parents outside the bucket are left to the caller."""
    cells = {x: chains[x].tolist() for x in ("c", "n", "d0", "d1", "s0", "s1", "q1", "q2", "z1", "z2", "n_children", "n_single")}
    own = [(n - 1) * (b - a) for n, a, b in zip(cells["n"], cells["s0"], cells["s1"], strict=True)]
    leaves = [single + (not every) for single, every in zip(cells["n_single"], cells["n_children"], strict=True)]
    bottom = {k: i for i, k in enumerate(zip(cells["d1"], cells["z1"], cells["z2"], strict=True))}
    parent = [bottom.get((d - 1, a, b), -1) for d, a, b in zip(cells["d0"], cells["q1"], cells["q2"], strict=True)]
    children: list[list[int]] = [[] for _ in own]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    below = [0] * len(own)
    for top in (i for i, p in enumerate(parent) if p < 0):
        stack = [(top, False)]
        while stack:
            i, seen = stack.pop()
            if not seen:
                stack.append((i, True))
                stack.extend((x, False) for x in children[i])
            elif parent[i] >= 0:
                leaves[parent[i]] += leaves[i]
                below[parent[i]] += below[i] + own[i]
    total = [a + b for a, b in zip(own, below, strict=True)]
    up = [-1 if p >= 0 else d - 1 for p, d in zip(parent, cells["d0"], strict=True)]
    return pd.DataFrame({"c": cells["c"], "n": cells["n"], "d1": cells["d1"], "s1": cells["s1"], "leaves": leaves, "below": below, "total": total, "up": up, "q1": cells["q1"], "q2": cells["q2"]})


def _folded(chains: DataFrame, root_depth: int, paths: DataFrame, subtrie: int, kept: list[str]) -> DataFrame:
    """``CHAIN`` rows of all chains: the root's is the one with d0 = 0."""
    spark = chains.sparkSession
    set_aside = [chains.where("d0 = 0")]
    rest, small, n_small = chains.where("d0 > 0").withColumn("cut", F.lit(root_depth).cast("long")), [], 0
    at_turn = paths.select("c", F.col("pos").alias("next"), F.col("p1").alias("g1"), F.col("p2").alias("g2"))
    while True:
        keyed, at = scratch.save(rest.withColumn("next", F.col("cut") + 1).join(at_turn, ["c", "next"]), "subtries")
        kept.append(at)
        sizes, at = scratch.save(keyed.groupBy("next", "g1", "g2").agg(F.count("*").alias("chains"), F.max(F.when(F.col("d0") == F.col("next"), F.col("d1"))).alias("bottom")), "sizes")
        kept.append(at)
        few, many = (sizes.agg(F.sum(F.when(x, F.col("chains"))), F.count_if(x)).first() for x in (F.col("chains") <= subtrie, F.col("chains") > subtrie))
        n_small += few[0] or 0
        if not many[1]:
            small.append(keyed)
            break
        large = sizes.where(F.col("chains") > subtrie).select("next", "g1", "g2", "bottom")
        small.append(keyed.join(large, ["next", "g1", "g2"], "left_anti"))
        split = keyed.join(large, ["next", "g1", "g2"])
        set_aside.append(split.where("d0 = next").select(*chains.columns))
        rest = split.where("d0 > next").select(*chains.columns, F.col("bottom").alias("cut"))
    whole = small[0]
    for x in small[1:]:
        whole = whole.unionByName(x)
    buckets = max(1, -(-n_small // subtrie))
    done = whole.withColumn("bucket", F.pmod(F.xxhash64("next", "g1", "g2"), F.lit(buckets))).groupBy("bucket").applyInPandas(fold, CHAIN)
    done, at = scratch.save(done, "folded")
    kept.append(at)
    for i, heads in enumerate(reversed(set_aside)):
        sums = done.where("up >= 0").groupBy(F.col("up").alias("d1"), F.col("q1").alias("z1"), F.col("q2").alias("z2")).agg(F.sum("leaves").alias("l"), F.sum("total").alias("b"))
        added = heads.join(sums, ["d1", "z1", "z2"], "left").select(
            "c", "n", "d1", "s1", (F.coalesce("l", F.lit(0)) + F.col("n_single") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), F.coalesce("b", F.lit(0)).alias("below"),
            (F.coalesce("b", F.lit(0)) + (F.col("n") - 1) * (F.col("s1") - F.col("s0"))).alias("total"), (F.col("d0") - 1).alias("up"), "q1", "q2",
        )
        added, at = scratch.save(added, f"added{i}")
        kept.append(at)
        done = done.unionByName(added)
    return done


def prefix_trie(rows: DataFrame, convs: DataFrame, subtrie: int = SUBTRIE) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a row per node of the trie.

    ``rows``: ``c, pos, t, d, size`` of every turn, as of ``rebuilt`` (place from 1, turns of the
    conversation, digest, code points); ``convs``: ``c, t`` of every conversation, turnless ones too.

    Null roles and texts are empty, null turns come first, equal turns go by digest, rows
    without a conv_id belong to no conversation.  Long texts are hashed whole; long
    conversations are split.  Repeated rows are turns of their own.  Other columns are
    ignored.  No conversation: no row, not even the root.
    """
    paths, kept = _paths(rows)
    nodes = paths.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("c").alias("c"), F.max("size").alias("size"), F.max("s").alias("s"), F.count_if(F.col("pos") == F.col("t")).alias("n_ends"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    root = convs.agg(F.count("*").alias("n"), F.min("c").alias("c"), F.count_if(F.col("t") == 0).alias("n_ends")).where("n > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*[zero.alias(x) for x in KEY], "n", "c", zero.alias("size"), zero.alias("s"), "n_ends", zero.alias("q1"), zero.alias("q2"))
    nodes, at = scratch.save(nodes.unionByName(root), "nodes")
    kept.append(at)
    inner = (F.col("n") > 1) | (F.col("pos") == 0)
    children = nodes.where("pos > 0").groupBy((F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("n_single"))
    shared = nodes.where(inner).join(children, KEY, "left").fillna(0, ["n_children", "n_single"])
    shared, at = scratch.save(shared, "shared")
    kept.append(at)
    last = lambda *x: F.max_by(F.struct(*x), "pos")
    chains = shared.groupBy("c", "n").agg(F.min("pos").alias("d0"), F.max("pos").alias("d1"), F.min_by(F.struct((F.col("s") - F.col("size")).alias("s0"), "q1", "q2"), "pos").alias("a"), last(F.col("s").alias("s1"), F.col("p1").alias("z1"), F.col("p2").alias("z2"), "n_children", "n_single").alias("z"))
    chains, at = scratch.save(chains.select("c", "n", "d0", "d1", "a.*", "z.*"), "chains")
    kept.append(at)
    top = chains.where("d0 = 0").first()
    folded = _folded(chains, top["d1"] if top else 0, paths, subtrie, kept)

    parents = shared.select((F.col("pos") + 1).alias("pos"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("c").alias("parent"), "n_children")
    placed = join_keyed(nodes.where("pos > 0"), parents, ["pos", "q1", "q2"], "n_children", "left").drop("n_children")
    placed = placed.withColumn("parent", F.coalesce("parent", "c"))  # only nodes of one conversation have none that is shared: the parent is the same one's
    ends = _ends(paths.where("pos = t").select(*KEY, "c").unionByName(convs.where("t = 0").select(*[zero.alias(x) for x in KEY], "c")))
    placed = placed.unionByName(nodes.where("pos = 0").withColumn("parent", F.lit(None).cast("long")))
    known = shared.join(folded.select("c", "n", "s1", "leaves", "below"), ["c", "n"]).select(*KEY, "n_children", "leaves", (F.col("below") + (F.col("n") - 1) * (F.col("s1") - F.col("s") + F.col("size"))).alias("saved"))
    group = placed.where(inner).join(known, KEY).join(ends, KEY, "left")
    single = placed.where(~inner)
    out = lambda df, children, leaves, saved, sha: df.select(F.col("c").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), children.cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), sha.alias("ends_sha256"))
    last_one: Column = F.col("n_ends") == 1
    return out(group, F.col("n_children"), F.col("leaves"), F.col("saved"), F.coalesce("ends_sha256", F.lit(EMPTY))).unionByName(
        out(single, F.when(last_one, 0).otherwise(1), F.lit(1), F.lit(0), F.when(last_one, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))))


def conversation_trie(convs: DataFrame, subtrie: int = SUBTRIE) -> DataFrame:
    """The trie of the rebuilt conversations of ``conv_id, turn, role, text``; see ``rebuilt`` and ``prefix_trie``."""
    rows, lengths, paths = rebuilt(convs)
    return prefix_trie(rows, lengths, subtrie)
