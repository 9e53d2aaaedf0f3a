"""Secret scans: fixed patterns, and a battery of randomness tests for tokens of no known shape.

A candidate is a run of 20 or more key characters.  Its encoding is inferred as the smallest
alphabet that has all of them, its characters become digits of that alphabet, and three tests
ask whether they could be uniformly random: chi-squared uniformity, runs of characters of one
class (small, capital, digit, sign), and lag-one serial correlation.  Tails are simulated for each length
and alphabet, as 20 characters over 64 cells are far from any limit law.

The three p-values are combined by Fisher's method.  A token whose combined value rules out
randomness is no secret.  For the others the same statistic is held against text of the same
encoding and length (words, identifiers, numbers), simulated too: how likely would text look
this random?  Those p-values go through Benjamini-Hochberg within each class of encoding and
length over the whole corpus, so long tokens, of which the tests know more, don't pay for
short ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: The combined tests must leave randomness this likely; the share of false finds allowed per class.
KEEP_P, FALSE_SHARE = 0.001, 0.01
#: Draws that simulate random tokens and texts; lengths beyond this use limit laws, and the text of this length.
DRAWS, TEXTS, LONGEST = 4000, 500, 256
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From small to large: the first that has all characters of a token is its encoding.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UP + "234567", "lower32": _LOW + "234567",
    "base36": _DIGITS + _LOW, "upper36": _DIGITS + _UP, "base62": _UP + _LOW + _DIGITS, "base64": _UP + _LOW + _DIGITS + "+/",
}
#: Letters of English per mille, a to z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: matches are found greedily, then short ones are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def encoding(body: str) -> str:
    """The smallest alphabet of a token without padding; ``-_`` stand for ``+/``."""
    chars = set(body.replace("-", "+").replace("_", "/"))
    return next(name for name, alphabet in ALPHABETS.items() if chars <= set(alphabet))


@cache
def _classes(name: str) -> np.ndarray:
    return np.array([0 if c in _LOW else 1 if c in _UP else 2 if c in _DIGITS else 3 for c in ALPHABETS[name]])


def battery(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chi-squared, number of class runs and standardised serial correlation of each row of digits of an encoding."""
    (m, n), k = x.shape, len(ALPHABETS[name])
    counts = np.bincount((np.arange(m)[:, None] * k + x).ravel(), minlength=m * k).reshape(m, k)
    chi = (counts.astype(np.float64) ** 2).sum(axis=1) * k / n - n
    kind = _classes(name)[x]
    runs = 1.0 + (kind[:, 1:] != kind[:, :-1]).sum(axis=1)
    c = x - x.mean(axis=1, keepdims=True)
    spread = (c * c).sum(axis=1)
    serial = np.where(spread > 0, (c[:, 1:] * c[:, :-1]).sum(axis=1) / np.where(spread > 0, spread, 1), 1.0)
    return chi, runs, serial * math.sqrt(n) + 1 / math.sqrt(n)


@cache
def _random_tails(name: str, n: int) -> tuple[np.ndarray, ...]:
    k = len(ALPHABETS[name])
    return tuple(np.sort(s) for s in battery(np.random.default_rng((k, n)).integers(0, k, (DRAWS, n)), name))


def uniform_tests(x: np.ndarray, name: str) -> np.ndarray:
    """3 x m two-sided p-values of the battery for rows of random digits of an encoding."""
    stats, n, k = battery(x, name), x.shape[1], len(ALPHABETS[name])
    normal = lambda z: np.array([math.erfc(v / math.sqrt(2)) for v in np.abs(z).tolist()])
    if n > LONGEST:
        share = np.bincount(_classes(name)) / k
        same, thrice = (share**2).sum(), (share**3).sum()  # chances that two and three in a row are of one class
        spread = (n - 1) * same * (1 - same) + 2 * (n - 2) * (thrice - same * same)
        runs = (stats[1] - 1 - (n - 1) * (1 - same)) / math.sqrt(spread)
        return np.array([normal((stats[0] - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)), normal(runs), normal(stats[2])])
    out = []
    for s, null in zip(stats, _random_tails(name, n), strict=True):
        tail = np.minimum(DRAWS - np.searchsorted(null, s, "left"), np.searchsorted(null, s, "right"))
        p = np.minimum(1.0, 2 * (1 + tail) / (DRAWS + 1))
        out.append(np.where(tail == 0, np.minimum(p, normal((s - null.mean()) / null.std())), p))  # no draw came that far
    return np.array(out)


def combined(p: np.ndarray) -> np.ndarray:
    """Fisher's statistic of the rows of p-values, in natural logs."""
    return -2 * np.log(np.maximum(p, 1e-300)).sum(axis=0)


def random_p(x: float) -> float:
    """The chance of that statistic or more from random tokens: chi-squared with six degrees of freedom."""
    return math.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def text_tokens(name: str, n: int, m: int) -> np.ndarray:
    """m texts of n characters as digits of the encoding: numbers for the hexadecimal ones, else words and identifiers as its alphabet allows."""
    alphabet = ALPHABETS[name]
    rng = np.random.default_rng((list(ALPHABETS).index(name), n))
    if name in ("hex", "HEX"):
        return rng.integers(0, 10, (m, n))
    letters = rng.choice(26, m * n, p=np.array(LETTERS) / sum(LETTERS))
    coin, pick, size = rng.random(m * n), rng.integers(0, 10, m * n), rng.integers(2, 10, m * n)
    out = np.empty(m * n, np.int64)
    at = i = 0
    while at < m * n:
        stop = min(m * n, at + int(size[i]))
        camel = name in ("base62", "base64") and coin[i] < 0.5
        for j in range(at, stop):
            c = _LOW[letters[j]]
            if c not in alphabet or (camel and j == at):
                c = c.upper()
            out[j] = alphabet.index(c)
        if stop < m * n and name == "base64" and coin[stop] < 0.6:
            out[stop] = 62 + (coin[stop] < 0.2)
            stop += 1
        if coin[i] > 0.8 and name not in ("base32", "lower32"):
            for _ in range(1 + int(coin[i] > 0.9)):
                if stop < m * n:
                    out[stop] = alphabet.index(_DIGITS[pick[stop]])
                    stop += 1
        at, i = stop, i + 1
    return out.reshape(m, n)


@cache
def _text_law(name: str, n: int) -> tuple[float, float]:
    """Mean and deviation of the statistic's logarithm for texts."""
    x = np.log(np.maximum(0.05, combined(uniform_tests(text_tokens(name, n, TEXTS), name))))
    return float(x.mean()), max(0.05, float(x.std()))


def text_bin(x: float, name: str, n: int) -> int:
    """-10 log10 of the chance that a text of that encoding and length looks so random, up to 400."""
    mean, deviation = _text_law(name, min(n, LONGEST))
    z = (mean - math.log(max(0.05, x))) / deviation
    if z < 8:
        return int(-10 * math.log10(0.5 * math.erfc(z / math.sqrt(2))))
    return min(400, int((z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) * 10 / math.log(10)))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, class, bin of the text hypothesis, whether it could be random) of the tokens outside base spans."""
    out, reach, i = [], -1, 0
    for m in CANDIDATE.finditer(text):
        while i < len(base) and base[i][0] <= m.start():  # both are in order of their starts
            reach = max(reach, base[i][2])
            i += 1
        if m.end() <= reach:
            continue
        body = (m[0].rstrip("=") or m[0]).replace("-", "+").replace("_", "/")
        name = encoding(body)
        digits = np.array([list(map(_places(name).__getitem__, body))])
        x = float(combined(uniform_tests(digits, name))[0])
        out.append((m.start(), m.end(), 64 * list(ALPHABETS).index(name) + int(2 * math.log2(len(m[0]) / 20)), text_bin(x, name, len(body)), random_p(x) >= KEEP_P))
    return out


@cache
def _places(name: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(ALPHABETS[name])}


_CAND = "array<struct<start:int,end:int,class:int,bin:int,random:boolean>>"


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates of every row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    schema = rows.select("doc_id", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>").alias("base"), F.lit(None).cast(_CAND).alias("tokens")).schema
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    token = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32()), ("random", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, tokens = [], []
            for t in b.column(1):
                text = t.as_py()
                found = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in found])
                tokens.append([dict(zip(("start", "end", "class", "bin", "random"), x, strict=True)) for x in candidates(text, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(tokens, token)], ["doc_id", "base", "tokens"])

    return rows.mapInArrow(run, schema)


def cutoffs(tokens: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Per class the least bin that Benjamini-Hochberg accepts; ``tokens`` has a row per candidate.

    With R candidates at a bin or beyond, of m in the class, the bin's p-value must be at
    most ``false_share`` R / m.  There are at most 512 classes of 401 bins.
    """
    bins = tokens.groupBy("class", "bin").agg(F.count("*").alias("n"))
    all_of = Window.partitionBy("class")
    bins = bins.withColumns({"m": F.sum("n").over(all_of), "r": F.sum("n").over(all_of.orderBy(F.desc("bin")))})
    return bins.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= false_share * F.col("r") / F.col("m")).groupBy("class").agg(F.min("bin").alias("cut"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row: an array of (start, end, kind) in code points, by start and kind.

    Kinds are assign, access, hex (fixed patterns) and random (the tests).  Null and empty
    texts have no spans.  Long texts are scanned whole, in time linear in their tokens.
    Spans of several kinds may overlap; those of one kind don't, and the leftmost wins.
    Repeated rows are scanned each and count each as evidence.  Values tied with a class's cut
    are found.  Other columns are ignored.  Empty table: no rows.
    """
    scratch.small_batches(docs.sparkSession)
    found, _ = scratch.save(_scan(docs), "secrets")
    cut = cutoffs(found.select(F.inline("tokens"))).agg(F.map_from_entries(F.collect_list(F.struct("class", "cut"))).alias("cut"))  # one row of 512 entries at most
    out = found.join(F.broadcast(cut), F.lit(True), "left")
    real = F.filter("tokens", lambda x: x["random"] & (x["bin"] >= F.element_at("cut", x["class"])))
    random = F.transform(real, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    spans = F.array_sort(F.concat("base", random))
    names = F.array(*[F.lit(k) for k in KINDS])
    return out.select("doc_id", F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), names[x["kind"]].alias("kind"))).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
