"""Token ids in Arrow files of fixed-size lists (operator 9).

One token file holds a run of the corpus as sequences of equal length: an Arrow IPC file whose record
batches have the columns ``ids`` (fixed-size list of unsigned integers) and ``mask`` (fixed-size list of
booleans, false only on the padding that ends a file). As all lists have one length, row *i* of a batch
lies at byte ``i * length * width`` of its buffer, so a memory-mapped file gives any sequence or mask
without a copy. Beside it, ``<stem>.docs.arrow`` has each document's place in the file.

Scale: rows are dealt once, by ranges of (doc_id, hash of the text), and each task sorts, encodes and writes its own
range, in as many files of about ``FILE_BYTES`` of text as that takes. Only one manifest row per file (its name and two
numbers) reaches the driver.

Defined cases: null and empty texts have the end id alone; a null doc_id sorts first; rows that repeat a
doc_id stay separate documents, in an arbitrary order among themselves; other columns are ignored;
an empty table writes no file and returns no row.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, attempt_name, files_frame, open_fs
from .word_memo import WordMemo
from .worker import guarded, held, pieces

#: Tokens in a sequence, sequences in a record batch, bytes of text in a file.
LENGTH, BATCH_ROWS, FILE_BYTES = 2048, 64, 48 << 20

#: Marks after a word that the tokenizer takes for a token run of their own; Latin letters; words remembered without them.
_MARKS = (".", ",", ";", ":", "!", "?", "!!", "...")
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower().isalpha())
_WORD = re.compile(f"([{_LETTERS}]+)([.,;:!?]|!!|\\.\\.\\.)?").fullmatch
_ROOM, CHECKED, JOINED = 250_000, 64, 1000


def _cut(word: str) -> tuple[str, str, bool]:
    """A word as its Latin letters in lower case and the mark after them, where the tokenizer is sure to part them so; else the word itself."""
    m = _WORD(word)
    return (m[1].lower(), m[2] or "", True) if m else (word, "", False)


def word_encoder(path: str) -> tuple[WordMemo, str]:
    """This process's encoder for a vocabulary that drops white space, and its smallest id type.

    Such a tokenizer splits at white space before it looks up anything, so a text's ids are those of its
    words one after the other."""

    def make() -> tuple[WordMemo, str]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        code = "H" if t.get_vocab_size() <= 1 << 16 else "I"
        whole = lambda words: [array(code, e.ids).tobytes() for e in t.encode_batch_fast(words, add_special_tokens=False)]
        marks = {m: ids for m, ids in zip(_MARKS, whole(list(_MARKS)), strict=True)}
        cores: dict[str, bytes] = {}
        # a token with this suffix ends a word: many words of letters go through the tokenizer as one text
        suffix = getattr(t.model, "end_of_word_suffix", None)
        last = np.zeros(t.get_vocab_size(), bool)
        last[[i for w, i in t.get_vocab().items() if suffix and w.endswith(suffix)]] = True

        def letters(words: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for i in range(0, len(words), JOINED):
                some = words[i : i + JOINED]
                ids = np.array(t.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, code)
                ends = (np.flatnonzero(last[ids]) + 1) * ids.itemsize
                if len(ends) == len(some):
                    flat, at = ids.tobytes(), [0, *ends.tolist()]
                    out += [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
                else:
                    out += whole(some)
            return out

        # a vocabulary that doesn't part letters from marks, or keeps case, is asked for whole words
        probes = [w for c in ("word", "Word", "WORD", "\u00c9t\u00e9", "x") for w in (c, *(c + m for m in _MARKS))]
        composed = [low + marks[m] if m else low for (_, m, _), low in zip(map(_cut, probes), whole([_cut(w)[0] for w in probes]), strict=True)]
        parts = composed == whole(probes)

        def encode(words: list[bytes]) -> list[bytes]:
            texts = [w.decode() for w in words]
            if not parts:
                return whole(texts)
            if len(cores) > _ROOM:
                cores.clear()
            cut = [_cut(x) for x in texts]
            for sure, ids_of in ((True, letters), (False, whole)):
                fresh = list({c for c, _, s in cut if s is sure and c not in cores})
                cores.update(zip(fresh, ids_of(fresh), strict=True))
            out = [cores[c] + marks[m] if m else cores[c] for c, m, _ in cut]
            # every so many words, the tokenizer itself says whether that was right
            if out[::CHECKED] != whole(texts[::CHECKED]):
                raise RuntimeError(f"{path} doesn't encode words by their letters and marks")
            return out

        return WordMemo(encode, bytes.split, 400_000), code

    return held("token_files", path, make)


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class TokenWriter:
    """Writes one token file and its document index."""

    def __init__(self, folder: str, stem: str, typecode: str, length: int = LENGTH, batch_rows: int = BATCH_ROWS):
        self.fs, self.at = open_fs(folder)
        self.fs.create_dir(self.at, recursive=True)
        self.stem, self.length, self.step = stem, length, length * batch_rows
        self.dtype, self.kind = np.dtype(typecode), {"H": pa.uint16(), "I": pa.uint32()}[typecode]
        self.schema = _schema(self.kind, length)
        self.sink = self.fs.open_output_stream(f"{self.at}/{stem}.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[bytes] = []
        self.held = self.n = 0
        self.docs: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id, ids: bytes) -> None:
        k = len(ids) // self.dtype.itemsize
        for col, x in zip(self.docs, (doc_id, self.n, k), strict=True):
            col.append(x)
        self.parts.append(ids)
        self.held += k
        self.n += k
        if self.held >= self.step:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.parts), self.dtype)
        whole = len(flat) if last else len(flat) // self.step * self.step
        for i in range(0, whole, self.step):
            part = flat[i : min(i + self.step, whole)]
            mask = np.ones(-(-len(part) // self.length) * self.length, bool)
            mask[len(part) :] = False
            ids = np.zeros(len(mask), self.dtype)
            ids[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.parts = [flat[whole:].tobytes()]
        self.held = len(flat) - whole

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self.out.close()
        self.sink.close()
        t = pa.table({"doc_id": pa.array(self.docs[0], pa.int64()), "start": pa.array(self.docs[1], pa.int64()), "n_tokens": pa.array(self.docs[2], pa.int64())})
        with self.fs.open_output_stream(f"{self.at}/{self.stem}.docs.arrow") as sink, pa.ipc.new_file(sink, t.schema) as out:
            out.write_table(t)
        return self.stem, len(t), self.n


class TokenFile:
    """Random access to one token file; memory-mapped where the store is a local one."""

    def __init__(self, folder: str, stem: str):
        fs, at = open_fs(folder)
        local = fs.type_name == "local"
        opened = [pa.memory_map(f"{at}/{stem}{x}") if local else pa.BufferReader(fs.open_input_file(f"{at}/{stem}{x}").readall()) for x in (".arrow", ".docs.arrow")]
        self.file, docs = pa.ipc.open_file(opened[0]), pa.ipc.open_file(opened[1]).read_all()
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.firsts = list(np.cumsum([0, *(b.num_rows for b in self.batches)]))
        self.length = self.file.schema.field("ids").type.list_size
        self.docs = docs

    def __len__(self) -> int:
        return self.firsts[-1]

    def _row(self, i: int):
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect.bisect_right(self.firsts, i) - 1
        return self.batches[k], i - self.firsts[k]

    def sequence(self, i: int) -> np.ndarray:
        """Sequence ``i``: a view of the file, not a copy."""
        b, j = self._row(i)
        return b.column(0).values.to_numpy(zero_copy_only=True)[j * self.length : (j + 1) * self.length]

    def mask(self, i: int) -> pa.Array:
        """The mask of sequence ``i``: a slice of the file's bits, not a copy."""
        b, j = self._row(i)
        return b.column(1).values.slice(j * self.length, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, whatever sequences they lie in."""
        if not n:
            return np.zeros(0, np.uint16)
        rows = range(start // self.length, (start + n - 1) // self.length + 1)
        own = np.concatenate([self.sequence(i) for i in rows])
        return own[start - rows[0] * self.length :][:n]


def write(docs: DataFrame, vocabulary: str, end_id: int, ws: Workspace, length: int = LENGTH, file_bytes: int = FILE_BYTES) -> list:
    """Encodes ``docs`` (doc_id, text) and writes token files in ascending doc_id order.

    Returns the manifest: rows (file, docs, tokens) in that order."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    # rows of one doc_id can lie in several ranges, should a large share have it
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    folder = f"{ws.path}/tokens"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, code = word_encoder(vocabulary)
        end, out, done, size = np.array([end_id], code).tobytes(), None, [], 0
        for p in pieces("token_files", parts, "text"):
            out = out or TokenWriter(folder, f"{attempt_name()}-{len(done)}", code, length)
            texts = [b.to_pybytes() if (b := t.as_buffer()) else b"" for t in p.column("text")]
            for d, ids in zip(p.column("doc_id").to_pylist(), memo.encode(texts), strict=True):
                out.add(d, ids + end)
            size += sum(map(len, texts))
            if size >= file_bytes:
                done.append(out.close())
                out, size = None, 0
        if out is not None:
            done.append(out.close())
        n, own = len(done), list(zip(*done, strict=True)) or ([], [], [])
        cols = [pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(own[0], pa.string()), *(pa.array(x, pa.int64()) for x in own[1:])]
        yield pa.record_batch(cols, ["bucket", "part", "file", "docs", "tokens"])

    done = ws.save(dealt.mapInArrow(task, "bucket int, part int, file string, docs long, tokens long"), "manifest")
    return [(r["file"], r["docs"], r["tokens"]) for r in done.orderBy("bucket", "part").collect()]


def read(spark: SparkSession, ws: Workspace, manifest: list) -> DataFrame:
    """Every document of the files: doc_id, start (its first id's place in the corpus), n_tokens, ids_crc32."""
    rows, base = [], 0
    for file, _, tokens in manifest:
        rows.append((file, base))
        base += tokens
    folder, kind = f"{ws.path}/tokens", "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], kind)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in guarded("token_files", parts):
            for stem, base in zip(p.column("file").to_pylist(), p.column("base").to_pylist(), strict=True):
                f = TokenFile(folder, stem)
                start, n = f.docs["start"].to_numpy(), f.docs["n_tokens"].to_numpy()
                crc = [zlib.crc32(f.tokens(int(s), int(k)).astype("<u4").tobytes()) for s, k in zip(start, n, strict=True)]
                yield pa.record_batch([f.docs["doc_id"].combine_chunks(), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files_frame(spark, rows, "file string, base long").mapInArrow(task, kind)
