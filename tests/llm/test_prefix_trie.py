import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from petrel.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    return sorted((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, v in members.items())


@pytest.fixture(scope="module")
def convs():
    """Shared and equal conversations, nulls, ties, repeated rows, missing and short family heads, one long conversation and its copy."""
    rng = random.Random(7)
    out = []
    for c in [*range(0, 40), *range(100, 130), *range(201, 240), -5, 300, 301, 302, 303]:
        n = rng.randint(1, 3) if c in (100, 300) else rng.randint(1, 9)
        out += [(c, t if rng.random() > 0.1 else None, rng.choice(("user", "assistant", None)), rng.choice((None, "", "hello", "yes é", "no", "word " * rng.randint(1, 40)))) for t in range(n)]
        if rng.random() < 0.2:
            out += out[-1:]
    for c in (400, 401, 500, 501, 502):
        out += [(c, t, "user", f"turn {t}") for t in range(90 if c < 502 else 60)]
    return out + [(401, 90, "user", "end"), (None, 0, "user", "nobody's"), (777, 5, "a", "x" * 9000)]


@pytest.mark.parametrize(("subtrie", "block", "parts"), [(20_000, 4096, 1), (3, 7, 5)])
def test_equals_brute_force(spark, convs, subtrie, block, parts, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", block)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    try:
        df = spark.createDataFrame([(*x, "clash", 1) for x in convs], SCHEMA + ", d string, n int").repartition(parts)
        got = pt.conversation_trie(df, subtrie=subtrie)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute(convs), key=repr)
        assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_and_none(spark):
    one = [(7, 0, "user", "a"), (7, 1, "user", "b")]
    assert sorted((tuple(r) for r in pt.conversation_trie(spark.createDataFrame(one, SCHEMA)).collect()), key=repr) == sorted(brute(one), key=repr)
    turnless = [(203, 0, "user", "a")]  # its head replaces all its turns, and the family's first is missing
    assert sorted((tuple(r) for r in pt.conversation_trie(spark.createDataFrame(turnless, SCHEMA)).collect()), key=repr) == sorted(brute(turnless), key=repr)
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
