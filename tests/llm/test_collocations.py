import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from petrel.llm import collocations as co

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang or "und"] += len(words)
            counts[lang or "und"].update(" ".join(words[i : i + d]) for d in range(1, 6) for i in range(len(words) - d + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if a >= least and " " in p}
        gone = set()
        for p, a in found.items():
            w = p.split(" ")
            parts = {" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)} - {p}
            gone |= {s for s in parts if 100 * a >= 100 * found[s]}
        rows = []
        for p in found.keys() - gone:
            w = p.split(" ")
            cuts = [(1000 * found[p] * total[lang] // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -found[p], p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(lang, i, p.decode(), -a, le, ri, total[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    """Frequent phrases, repeats of one word, ties, other white space, nulls and a long text."""
    rng = random.Random(11)
    words = [rng.choice(("Ünï", "the", "of", "a-b", "x\x00y", "\x1cq", "λόγος")) + str(i) for i in range(14)]
    line = lambda n: "".join(rng.choice(words) + rng.choice((" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " \r")) for _ in range(n))
    fixed = ["new york city hall of", "New York City hall", "ha ha ha ha ha ha", "one two", "one two"]
    out = [(rng.choice(("en", "fr", None, "und")), line(40) + rng.choice(fixed)) for _ in range(120)]
    return out + [("en", None), (None, ""), ("fr", " \t\n.. "), ("en", line(20000)), ("en", "ha " * 300)] + [out[3]] * 9


@pytest.mark.parametrize("least", [2, 12])
def test_equals_brute_force(spark, texts, least, monkeypatch):
    monkeypatch.setattr(co, "SHARD", 3000)  # closures carry it to the workers: several shards a task
    df = spark.createDataFrame([(i, t, lang, "clash", 1) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    got = co.collocations(df, top=40, least=least)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, least, 40)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]


def test_suffixes_are_sorted_and_counted():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, 400).astype(np.int32)
    x[-1] = 0
    order = co.suffix_array(x, 5)
    key = lambda i: tuple(x[i : i + 5])
    assert [key(i) for i in order] == sorted(key(i) for i in np.flatnonzero(x))
    want = Counter(tuple(x[i : i + d]) for d in (2, 3, 4, 5) for i in range(len(x) - d + 1) if (x[i : i + d] > 0).all())
    assert {tuple(x[i : i + d].tolist()): int(n) for d, at, counts in co.intervals(x, order, 2, 5) for i, n in zip(at, counts, strict=True)} == {tuple(map(int, k)): n for k, n in want.items()}


def test_runs_hold_the_phrases_that_begin_there():
    x = np.array([5, 6, 7, 8, 9, 1, 2, 0], np.int32)
    assert co.runs(x, np.array([0, 1, 4]), 2).tolist() == [5, 6, 7, 0, 9, 1, 0]
    assert co.runs(x, np.array([0, 2]), 3).tolist() == [5, 6, 7, 0, 7, 8, 9, 0]
    assert co.runs(x, np.array([], np.int64), 2).tolist() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    words = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 7 * 10**11)], "lang string, phrase string, words int, f long")
    grams = spark.createDataFrame([("en", "a b", 2, 6 * 10**11)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(co, "frequent", lambda *a: (words, grams, []))
    a, n, le, ri = 6 * 10**11, 3 * 10**12 + 7 * 10**11, 3 * 10**12, 7 * 10**11
    assert tuple(co.collocations(None).first()) == ("en", 1, "a b", a, le, ri, n, 1000 * a * n // (le * ri))


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


@pytest.mark.parametrize("held", [5, 40, 10_000])
def test_shards_of_a_task_are_added_up(held):
    rng = random.Random(2)
    parts = [pa.RecordBatch.from_pydict({"phrase": [rng.choice("abcdefgh") for _ in range(20)], "n": [rng.randint(1, 9) for _ in range(20)]}) for _ in range(30)]
    want, got, rows = Counter(), Counter(), 0
    for p in parts:
        for r in p.to_pylist():
            want[r["phrase"]] += r["n"]
    for p in co.added_up(iter(parts), held):
        rows += len(p)
        for r in p.to_pylist():
            got[r["phrase"]] += r["n"]
    assert got == want and rows < 600 and (held < 40 or rows == 8)
    assert list(co.added_up(iter([]), held)) == []


def test_each_length_is_counted_in_one_pass(spark, texts, monkeypatch):
    # the last pass gives out phrases beyond the filters' lengths only: pairs and triples are counted before it
    passes = []
    by_shard = co._by_shard

    def kept(*a):
        passes.append(by_shard(*a))
        return passes[-1]

    monkeypatch.setattr(co, "_by_shard", kept)
    df = spark.createDataFrame(texts, "lang string, text string").repartition(2)
    grams = co.frequent(df, 12)[1].collect()
    lengths = [{sum(v != 0 for k, v in r.asDict().items() if k != "n") for r in rows.collect()} for rows in passes[1:]]
    assert lengths == [{2}, {3}, {4, 5}]
    assert {r["words"] for r in grams} == {2, 3, 4, 5} and all(len(r["phrase"].split(" ")) == r["words"] for r in grams)


def test_words_that_share_a_key_are_salted_anew(spark, texts, monkeypatch):
    words = lambda *keys: spark.createDataFrame([("en", str(i), k) for i, k in enumerate(keys)], "lang string, phrase string, key long")
    assert not co.shared_keys(words(1, 2, -1)) and co.shared_keys(words(1, 2, 1)) and co.shared_keys(words(1, 0))
    seen, real = [], co.shared_keys
    monkeypatch.setattr(co, "shared_keys", lambda w: seen.append({r["key"] for r in w.collect()}) or len(seen) < 2 or real(w))
    df = spark.createDataFrame(texts, "lang string, text string").repartition(2)
    assert sorted(tuple(r) for r in co.collocations(df, top=40, least=12).collect()) == brute(texts, 12, 40)
    assert len(seen) == 2 and not seen[0] & seen[1]
