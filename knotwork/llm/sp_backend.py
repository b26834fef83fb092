"""SentencePiece models on the tokenizers library (operator 10).

The model file is parsed here; its normaliser, white-space marker, scores (unigram) or merges (byte-pair),
and byte fallback are rebuilt from it. Pieces hold the marker at their start alone (or are made of markers),
and the line feed in no longer piece, so texts split before spaces and around line feeds; each distinct
part is encoded once per process, and compared with what the sentencepiece library makes of it.

Scale: one pass over the texts, no exchange; the memory of parts is bounded. Batches are encoded with as many threads
as RAYON_NUM_THREADS names (the tokenizers library's setting); a task counts as one core, so set it with spark.task.cpus.

Defined cases: null and empty texts have no ids; the marker's own character in a text counts as a space, as
it does in sentencepiece; ``parity`` is false for a text with any part that the libraries encode differently
(its ids are then those of this backend); rows that repeat give equal results; other columns are ignored.
Models with user-defined or unused pieces, or of type word or char, are refused.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .word_memo import WordMemo, batches
from .worker import held, pieces

MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text worked on at a time.
SLICE = 1 << 20


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) pairs of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        match key & 7:
            case 0:
                value, i = _varint(b, i)
            case 1:
                value, i = b[i : i + 8], i + 8
            case 2:
                n, i = _varint(b, i)
                value, i = b[i : i + n], i + n
            case 5:
                value, i = struct.unpack("<f", b[i : i + 4])[0], i + 4
            case _:
                raise ValueError("not a protobuf message")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    unk_id: int


def parse(data: bytes) -> Model:
    """A serialized SentencePiece model."""
    pieces, trainer, normalizer = [], {}, {}
    for k, v in fields(data):
        if k == 1:
            own = dict(fields(v))
            pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif k == 2:
            trainer = dict(fields(v))
        elif k == 3:
            normalizer = dict(fields(v))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE) or any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, t in pieces) or trainer.get(24, 0) or not normalizer.get(5, 1):
        raise ValueError("this kind of SentencePiece model isn't supported")
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    return Model(pieces, kind, bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), unk)


def merges(m: Model) -> list[tuple[str, str]]:
    """Every pair of pieces that make a piece, in the order in which they are merged: by score, then by id."""
    ids = {p: i for i, (p, _, t) in enumerate(m.pieces) if t == NORMAL}
    order = sorted((-s, i, p) for i, (p, s, t) in enumerate(m.pieces) if t == NORMAL)
    return [(p[:k], p[k:]) for _, _, p in order for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]


def build(m: Model, whole: bool = True):
    """The tokenizer; without ``whole`` for parts of texts that are already normalised and marked."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unk = m.pieces[m.unk_id][0]
    if m.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback))
    else:
        t = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if whole:
        steps += [normalizers.Prepend(MARK)] if m.dummy_prefix else []
        t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t, normalizers.Sequence(steps) if m.charsmap or m.squeeze else None


class Backend:
    """Encodes and decodes batches of texts; checks what is new against the sentencepiece library."""

    def __init__(self, data: bytes, check: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        self.model = m = parse(data)
        self.part, self.normalizer = build(m, whole=False)
        longer = [p for p, _, t in m.pieces if t == NORMAL and len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            raise ValueError("a piece has the white-space marker after another character")
        # parts are runs of spaces with what follows; a line feed stands alone where no piece joins it to anything
        self.split = re.compile(rb" *[^ \n]+| +|\n" if not any("\n" in p for p in longer) else rb" *[^ ]+| +").findall
        self.typecode = "H" if len(m.pieces) <= 1 << 16 else "I"
        self.bad: set[bytes] = set()
        self.reference = None
        if check:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        # other models change more of a text than its parts show: for these, whole texts are compared
        self.by_part = bool(self.reference and m.dummy_prefix and not m.squeeze and not m.charsmap)
        self.memo = WordMemo(self._encode, self.split, 200_000)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t == NORMAL else b"" if t == CONTROL else b" \xe2\x81\x87 " for p, _, t in m.pieces]

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        ids = [e.ids for e in self.part.encode_batch_fast([p.decode().replace(" ", MARK) for p in parts], add_special_tokens=False)]
        if self.by_part:
            # a part that starts with a space is a text that has the dummy prefix; others are put behind a line feed
            lead = len(self.reference.encode("\n"))
            texts = [p[1:].decode() if p[:1] == b" " else "\n" + p.decode() for p in parts]
            wanted = self.reference.encode(texts, num_threads=1)
            for p, t, own, want in zip(parts, texts, ids, wanted, strict=True):
                # the library adds no prefix to an empty text: a lone space is the marker
                if t and own != (want if p[:1] == b" " else want[lead:]):
                    self.bad.add(p)
        return [array(self.typecode, i).tobytes() for i in ids]

    def _marked(self, text: str) -> bytes:
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        text = text.replace(MARK, " ")
        return ((" " if self.model.dummy_prefix else "") + text).encode() if text else b""

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text (bytes of an array of ``typecode``), and whether the libraries agree on it."""
        marked = [self._marked(t) for t in texts]
        ids = [x for s in batches(marked, SLICE) for x in self.memo.encode(marked[s])]
        if self.reference and not self.by_part:
            wanted = self.reference.encode(texts, num_threads=1)
            return ids, [array(self.typecode, want).tobytes() == bytes(own) for own, want in zip(ids, wanted, strict=True)]
        return ids, [not self.bad or self.bad.isdisjoint(self.split(t)) for t in marked]

    def decode(self, ids: bytes) -> str:
        """The text of ids."""
        out = b"".join(map(self.bytes_of.__getitem__, array(self.typecode, ids)))
        return out[1 if self.model.dummy_prefix and out[:1] == b" " else 0 :].decode("utf-8", "replace")


def backend(path: str, check: bool = True) -> Backend:
    """This process's backend for a model file, as long as its tasks are those of this operator."""

    def make() -> Backend:
        with open(path, "rb") as f:
            return Backend(f.read(), check)

    return held("sentencepiece", (path, check), make)


def _encoded(docs: DataFrame, path: str, name: str, kind: str, ids_column) -> DataFrame:
    """The rows of ``docs`` encoded; ``ids_column`` makes the column ``name`` of all ids and each row's place in them."""
    ship(docs.sparkSession)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(path)
        # some text at a time: very long texts come alone
        for p in pieces("sentencepiece", parts, "text", most=SLICE):
            texts = [t or "" for t in p.column("text").to_pylist()]
            ids, same = own.encode(texts)
            back = [own.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            flat = np.frombuffer(b"".join(ids), own.typecode)
            n = np.array([len(i) // array(own.typecode).itemsize for i in ids], np.int64)
            del ids, texts
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.record_batch([p.column("doc_id"), ids_column(flat, at), pa.array(n), pa.array(same, pa.bool_()), pa.array(back)], ["doc_id", name, "n_tokens", "parity", "roundtrip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task, f"doc_id long, {name} {kind}, n_tokens long, parity boolean, roundtrip boolean")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids, n_tokens, parity, and roundtrip (decoding gives the text)."""
    lists = lambda flat, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
    return _encoded(docs, path, "ids", "array<int>", lists)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """What ``encode`` gives, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""

    def crc(flat, at):
        flat = flat.astype("<u4")
        return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)], pa.int64())

    return _encoded(docs, path, "ids_crc32", "long", crc)
