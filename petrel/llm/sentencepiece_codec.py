"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (a protobuf of pieces with scores, a trainer and a normaliser
spec) and rebuilt from the library's parts: precompiled normaliser, white-space folding,
metaspace marker, unigram scores or merges ranked by score, byte fallback, and the decoder
that undoes them.  Where no piece runs across words, the model's tokens of each new word are
remembered; else batches are encoded on several threads inside each task.  The reference
library re-encodes the whole texts, on several threads too, to verify parity.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Texts of a batch that are encoded together hold at most so many characters, unless one alone is longer.
BATCH_CHARS = 1_000_000
#: Words that a worker remembers, about 150 bytes each.
MEMO_WORDS = 500_000


def default_model() -> str:
    """The public SentencePiece model of this machine; any other path can be given instead."""
    return os.environ.get("PETREL_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, other wire types as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[i : i + n]
        i += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_spaces: bool = True
    escape_spaces: bool = True


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap, m.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
            m.fold_spaces, m.escape_spaces = bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return m


def merges(model: Model) -> list[tuple[str, str]]:
    """All ways to join two pieces into a third, best score first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    found = [(-s, p, i) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
    return [(p[:i], p[i:]) for _, p, i in sorted(found)]


def words_apart(model: Model) -> bool:
    """No piece runs across the start of a word, so a text's ids are those of its words in turn."""
    return all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL) and not any(kind == USER for _, _, kind in model.pieces)


def build(model: Model):
    """The tokenizers pipeline of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram (1) nor BPE (2)")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.fold_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if words_apart(model):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(WORD.pattern), "isolated")
    own = [AddedToken(p, normalized=True, special=False) for p, _, kind in model.pieces if kind == USER]
    if own:
        t.add_tokens(own)
    steps = [decoders.Metaspace(MARK, prepend_scheme="never"), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(steps)
    return t


class Codec:
    """A tokenizer of one Python worker, with the reference library beside it for parity."""

    _made: dict[str, Codec] = {}

    def __init__(self, data: bytes, threads: int = 2) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import decoders, normalizers

        model = parse_model(data)
        self.tokenizer = build(model)
        self.words = None
        if words_apart(model):
            self.words = build(model)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = None
            self.words.decoder = decoders.Sequence([decoders.Metaspace(MARK, prepend_scheme="never"), decoders.ByteFallback(), decoders.Fuse()])  # the first word's space stays
        self.memo: dict[str, bytes] = {}
        #: Words that decode to something else, which is held here.
        self.changed: dict[str, str] = {}
        #: What a piece stands for in a word; empty where only the decoder can tell (bytes, unknown, control).
        self.spelt = [p if kind == NORMAL and not p.startswith("<0x") else "" for p, _, kind in model.pieces]
        self.plain = not model.charsmap and not model.fold_spaces and model.escape_spaces
        self.prefix = MARK if model.dummy_prefix else ""
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.decimal = [str(i) for i in range(len(model.pieces))]

    @classmethod
    def of(cls, data: bytes, threads: int) -> Codec:
        key = f"{hashlib.sha256(data).hexdigest()}:{threads}"
        if key not in cls._made:
            cls._made[key] = cls(data, threads)
        return cls._made[key]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as 32-bit numbers."""
        return self.there_and_back(texts)[0]

    def there_and_back(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids of every text as 32-bit numbers, and what they decode to. Where words are apart, each new word is encoded and decoded once (the memo is emptied when it is large)."""
        pack = lambda ids: array("i", ids).tobytes()
        if self.words is None:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return list(map(pack, ids)), self.decode(ids)
        memo, changed = self.memo, self.changed
        normal = list(map(self.normal, texts))
        split = list(map(WORD.findall, normal))
        if len(memo) > MEMO_WORDS:
            memo.clear()
            changed.clear()
        new = list(set().union(*split).difference(memo))
        tokens = self.words.model.tokenize  # of a word that has neither normaliser nor splitting before it, so no encoding is built
        ids = [[t.id for t in tokens(w)] for w in new]
        memo.update(zip(new, map(pack, ids), strict=True))
        spelt = self.spelt.__getitem__
        other = [(w, g) for w, g in zip(new, ids, strict=True) if "".join(map(spelt, g)) != w]  # the rest are their pieces in turn
        back = self.words.decode_batch([g for _, g in other], skip_special_tokens=False)
        changed.update((w, t) for (w, _), t in zip(other, back, strict=True) if t != w.replace(MARK, " "))
        decoded = []
        for text, words in zip(normal, split, strict=True):
            if changed and not changed.keys().isdisjoint(words):
                text = "".join([changed.get(w, w.replace(MARK, " ")) for w in words])
            else:  # every word decodes to itself
                text = text.replace(MARK, " ")
            decoded.append(text.removeprefix(" ") if self.prefix else text)
        return [b"".join(map(memo.__getitem__, words)) for words in split], decoded

    def normal(self, text: str) -> str:
        if self.plain:  # what the normaliser does for a model without a character map
            return self.prefix * bool(text) + text.replace(" ", MARK)
        return self.tokenizer.normalizer.normalize_str(text)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def model_bytes(df: DataFrame, path: str) -> tuple[str, object]:
    """The model reaches executors as a broadcast: its size is a file's, half a megabyte to a few."""
    with open(path, "rb") as f:
        data = f.read()
    return data, df.sparkSession.sparkContext.broadcast(data)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BATCH_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode(docs: DataFrame, model_path: str | None = None, threads: int = 2, ids: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, ids, n_tokens, n_chars, ids_sha256, decoded_sha256, round_trip, parity`` of every row.

    ``round_trip``: decoding gives the text back.  It is false only where the model's
    normaliser changes texts.  ``ids`` and all that follows from them are those of the rebuilt
    tokenizer.  ``parity``: the reference library gives the same ids; false where it does not
    (ties between overlapping merges of one piece).  ``ids_sha256`` is over the ids as decimal numbers, comma-joined.
    ``ids=False`` leaves the array out.

    Null and empty texts have no ids and are decoded as empty.  Very long texts are encoded
    alone, whole.  Repeated rows are encoded each.  Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    _, model = model_bytes(docs, model_path or default_model())
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    out = {"ids": "array<int>", "n_tokens": "bigint", "n_chars": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean", "parity": "boolean"}
    if not ids:
        del out["ids"]
    schema = rows.select(*keep, *[F.lit(None).cast(t).alias(n) for n, t in out.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model.value, threads)
        for b in batches:
            done = 0
            for texts in _slices(b.column(len(keep)).to_pylist()):
                packed, back = codec.there_and_back(texts)
                parity = [g == w.tobytes() for g, w in zip(packed, codec.reference.encode(texts, num_threads=threads, out_type="numpy"), strict=True)]
                packed = [np.frombuffer(g, np.int32) for g in packed]
                columns = {
                    "n_tokens": pa.array([len(g) for g in packed], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(",".join(map(codec.decimal.__getitem__, g.tolist())).encode()).hexdigest() for g in packed]),
                    "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    "round_trip": pa.array([a == t for a, t in zip(back, texts, strict=True)]), "parity": pa.array(parity),
                }
                if ids:
                    columns["ids"] = pa.array(packed, pa.list_(pa.int32()))
                kept = [b.column(i).slice(done, len(texts)) for i in range(len(keep))]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*kept, *[columns[n] for n in out]], [*keep, *out])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str | None = None, threads: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text, no ids an empty one."""
    _, model = model_bytes(encoded, model_path or default_model())
    rows = encoded.select(*keep, "ids")
    schema = rows.select(*keep, F.lit("").cast("string").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model.value, threads)
        for b in batches:
            ids = b.column(len(keep)).to_pylist()
            texts = codec.decode([x or [] for x in ids])
            text = pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], text], [*keep, "text"])

    return rows.mapInArrow(run, schema)
