"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every term has a fixed sparse ternary index vector.  A term's word vector is its own index
vector plus the normalised sum of those of its neighbours in all texts of the corpus (random
indexing).  A document is the mean vector of its terms; a network with one hidden layer,
trained in numpy, scores it, and a temperature fitted on held-back training rows calibrates
the probability.

A word gives two terms: its letters in lower case, and its shape (runs of capitals, small
letters and digits as one sign each, other characters as they are, repeats once).  A word
equal to the one before gives a third.  Terms are hashed to a fixed number of buckets, so
the model has a fixed size, 2 MB, whatever the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

BUCKETS, DIMS, NONZERO, WINDOW, HIDDEN = 8192, 64, 6, 2, 32
#: Labelled documents that training uses at most, the first by hash of doc_id.
MAX_TRAIN = 6000
#: Words whose neighbours are summed at once: a few MB, so that the sums stay in a core's cache.
BLOCK_WORDS = 16_384
THRESHOLD = 0.3
HELD_OUT_OF = 5

_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(.)\1+", re.S)
_SIGNS = {c: "X" if chr(c).isupper() else "x" if chr(c).islower() else "9" for c in range(0x250) if chr(c).isupper() or chr(c).islower() or chr(c).isdigit()}


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(HELD_OUT_OF)) == 0


def _bucket(term: str) -> int:
    return 2 + zlib.crc32(term.encode("utf-8", "surrogatepass")) % (BUCKETS - 2)


_SMALL = _bucket("sx")


def _word_terms(word: str) -> int:
    """Both buckets of a word in one number."""
    if word.islower() and word.isascii() and word.isalpha():
        return _bucket("w" + word) * BUCKETS + _SMALL  # the same, without the patterns
    letters = "".join(_LETTERS.findall(word)).lower()
    shape = _RUNS.sub(r"\1", word.translate(_SIGNS))
    return _bucket("w" + letters) * BUCKETS + _bucket("s" + shape)


class Terms(dict):
    """Buckets of a text's terms. Words are remembered; the memo is emptied when it is large, so memory is bounded."""

    def __missing__(self, word: str) -> int:
        self[word] = both = _word_terms(word)
        return both

    def __call__(self, text: str) -> np.ndarray:
        """n x 2 of letters and shape, in order of the words."""
        if len(self) > 300_000:
            self.clear()
        words = text.split()
        both = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return np.stack((both // BUCKETS, both % BUCKETS), axis=1)


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors of all buckets, from a fixed seed."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    at = rng.integers(0, DIMS, (BUCKETS, NONZERO))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO)), axis=1)
    return out


def _add_neighbours(sums: np.ndarray, terms: list[np.ndarray], index: np.ndarray) -> None:
    """Add to ``sums`` the index vectors of the neighbours of each term; the arrays of ``terms`` are texts of their own.

    Term 0 stands between texts; its index vector has to be zero, and its sum means nothing.
    """
    gap = np.zeros((WINDOW, 2), np.uint16)
    both = np.concatenate([gap, *[x.astype(np.uint16) for text in terms for x in (text, gap)]])
    for t in (both[:, 0].copy(), both[:, 1].copy()):  # letters with letters, shape with shape
        for i in range(WINDOW, len(t) - WINDOW, BLOCK_WORDS):
            near = index[t[i - WINDOW : i + BLOCK_WORDS + WINDOW]]
            here = t[i : min(i + BLOCK_WORDS, len(t) - WINDOW)]
            n = len(here)
            around = near[:n] + near[2 * WINDOW : 2 * WINDOW + n]
            for d in range(1, WINDOW):
                around += near[d : d + n]
                around += near[2 * WINDOW - d : 2 * WINDOW - d + n]
            order = np.argsort(here, kind="stable")
            cut = np.flatnonzero(np.diff(here[order].astype(np.int32), prepend=-1))
            sums[here[order[cut]]] += np.add.reduceat(around[order], cut, axis=0)


def neighbour_sums(texts: Iterator[str], index: np.ndarray) -> np.ndarray:
    """Per bucket the sum of the index vectors of its neighbours: whole numbers, so the order of adding does not matter."""
    sums, terms = np.zeros((BUCKETS, DIMS), np.float64), Terms()
    index = index.copy()
    index[0] = 0
    held, size = [], 0
    for text in texts:
        t = terms(text)
        held.append(t)
        size += len(t)
        if size >= 8 * BLOCK_WORDS or len(held) >= BLOCK_WORDS:
            _add_neighbours(sums, held, index)
            held, size = [], 0
    if held:
        _add_neighbours(sums, held, index)
    sums[0] = 0
    return sums


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (index + sums / np.maximum(norm, 1e-9) * (norm > 0)).astype(np.float32)


def pooled(text: str, vectors: np.ndarray, terms: Terms) -> np.ndarray:
    t = terms(text)
    if not len(t):
        return np.zeros(2 * DIMS + 1, np.float32)
    counts = [np.bincount(t[:, k], minlength=BUCKETS) for k in (0, 1)] if len(t) > BUCKETS else None
    mean = [c @ vectors / len(t) for c in counts] if counts else [vectors[t[:, k]].mean(axis=0) for k in (0, 1)]
    again = np.mean(t[1:, 0] == t[:-1, 0]) if len(t) > 1 else 0.0
    return np.concatenate([*mean, [again]]).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale).astype(np.float64) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, spare: np.ndarray, epochs: int = 400, rate: float = 0.01) -> Network:
    """Fit by Adam on the rows that are not ``spare``; the temperature on those that are."""
    rng = np.random.default_rng(11)
    a, t = x[~spare], y[~spare].astype(np.float64)
    prior = (t.sum() + 1) / (len(t) + 2)
    net = Network(
        a.mean(axis=0) if len(a) else np.zeros(2 * DIMS + 1), (a.std(axis=0) if len(a) else np.zeros(2 * DIMS + 1)) + 1e-2,
        rng.normal(0, 0.1, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))),
    )
    if 0 < t.sum() < len(t):
        z = ((a - net.mean) / net.scale).astype(np.float64)
        p = [net.w1, net.b1, rng.normal(0, 0.1, HIDDEN), np.array(net.b2)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        for step in range(1, epochs + 1):
            h = np.tanh(z @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(t)
            back = e[:, None] * p[2] * (1 - h * h)
            grads = [z.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array(e.sum())]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3])
    if spare.any():
        logits, s = net.logits(x[spare]), y[spare]
        loss = lambda c: np.mean(np.logaddexp(0, -(2 * s - 1) * logits / c))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Word vectors of all documents, and a network trained on labelled ones that are not held out.

    The network sees ``max_train`` documents at most, the only sample taken; the driver gets one
    pooled vector for each of them and the neighbour sums of all buckets (8192 rows, 4 MB),
    which are summed by bucket across tasks.  A doc_id with several labels counts as good if
    they all say so; one with several texts is trained on the least of them.
    """
    scratch.small_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = marks.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    sample, path = scratch.save(sample, "training")
    index = index_vectors()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = neighbour_sums((t.as_py() for b in batches for t in b.column(0)), index)
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in sums[some].astype(np.int64)], pa.binary())], ["bucket", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_py(), np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["bucket", "sums"])

    schema = "bucket int, sums binary"
    parts = texts.select("text").mapInArrow(gather, schema).repartition("bucket").mapInArrow(total, schema).collect()  # a row per bucket, 4 MB at most
    sums = np.zeros((BUCKETS, DIMS))
    for part in parts:
        sums[part["bucket"]] = np.frombuffer(bytes(part["sums"]), np.int64)
    vectors = word_vectors(sums, index)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            x = [pooled(t.as_py(), vectors, terms).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], ["doc_id", "x", "y"])

    got = sample.select(F.col("doc_id").cast("string"), "text", F.col("y").cast("int")).mapInArrow(pool, "doc_id string, x binary, y int").toPandas()
    got = got.sort_values(["doc_id", "x"])
    scratch.drop(docs.sparkSession, path)
    x = np.array([np.frombuffer(bytes(r), np.float32) for r in got["x"]]).reshape(-1, 2 * DIMS + 1)
    spare = np.array([zlib.crc32(d.encode()) // HELD_OUT_OF % 5 == 0 for d in got["doc_id"]], bool)
    return Model(vectors, train(x, got["y"].to_numpy(np.int64), spare))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row, from its whole text (null counts as empty)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            x = np.array([pooled(t.as_py(), model.vectors, terms) for t in b.column(1)], np.float32).reshape(-1, 2 * DIMS + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.network.scores(x), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0.0).alias("score")).schema)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with their columns, whatever their names; nothing is shuffled.

    Null and empty texts score as a zero vector, repeated rows alike, long texts whole.  Empty table: no rows.
    """
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            x = np.array([pooled(t.as_py() or "", model.vectors, terms) for t in b.column(text)], np.float32).reshape(-1, 2 * DIMS + 1)
            kept = b.filter(pa.array(model.network.scores(x) >= threshold))
            yield pa.RecordBatch.from_arrays(kept.columns, names)

    plain = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(names)])  # an Arrow operator would read a dot as a path
    return plain.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts are scored like others, from a zero vector.  Long texts are pooled
    whole.  Repeated rows get the same score.  There are no ties to break, since documents are
    scored one by one; other columns are ignored.  Without labels, or with one label only, every score is the smoothed share
    of good labels.  Null doc_ids take part as the empty id.  Empty table: no rows.
    """
    out = score(docs, fit(docs, labels, max_train))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
