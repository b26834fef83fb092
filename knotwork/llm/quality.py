"""Quality classifier (operator 1): random indexing, a two-layer network, a temperature.

Every word has an index vector (sparse, ternary, drawn from its hash) and, where the training texts hold
it, a context vector: the sum of the index vectors around it. A token counts as up to three words: its
letters in lower case, its case, its punctuation. A document is the mean of its words' vectors with four
figures of how it repeats itself; a two-layer network, written in numpy, scores it; a temperature fitted on
rows that the network hasn't seen makes the score a probability.

Training: at most ``TRAIN_ROWS`` labelled rows, those with the least hash of doc_id, go to one task, of each at
most its first ``TRAIN_CHARS`` characters; those bounds don't depend on the input (at most 100 million characters).
Rows with crc32(doc_id) mod 3 = 1 are held out and never used. Scoring is one pass over whole texts, without an
exchange, some megabytes at a time; the model is ``ROWS`` x ``DIM`` numbers (16 MB), broadcast once.

Defined cases: null and empty texts have the zero vector and get its score; without labels of both values
the score is the share of label 1 (0.5 without any); a doc_id of null is never a training row and not held
out; repeated rows score alike; a doc_id with several labels or texts takes part with each pair of them, those of least
label, then text, first; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import thinned, trim_driver
from .worker import EVERY, give_back, held, sizes, spans

TRAIN_ROWS, TRAIN_CHARS = 6000, 16_384
DIM, ROWS, WINDOW, HIDDEN, NONZERO = 64, 1 << 16, 2, 32, 6
_EDGES = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
_ROOM = 100_000


def held_out(doc_id) -> object:
    """Whether a row is kept from training (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_row(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & (ROWS - 1)


def token_rows(token: str) -> int:
    """The rows of a token's letters, case and punctuation, 16 bits each."""
    a, core, b = _EDGES.match(token).groups()
    case = "^upper" if len(core) > 1 and core.isupper() else "^digit" if core[:1].isdigit() else "^title" if core[:1].isupper() else "^low" if core else "^none"
    return word_row(core.lower()) | word_row(case) << 16 | word_row(f"{a} {b}") << 32


class Rows:
    """Token rows with a memory of bounded size."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, tokens) -> np.ndarray:
        if len(self.known) > _ROOM:
            self.known = {}
        known = self.known
        for t in tokens:
            if t not in known:
                known[t] = token_rows(t)
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each row, from a fixed seed."""
    r = np.random.default_rng(7)
    out = np.zeros((ROWS, DIM), np.float32)
    at = np.concatenate([np.argsort(r.random((ROWS // 16, DIM)), axis=1)[:, :NONZERO] for _ in range(16)])
    out[np.arange(ROWS)[:, None], at] = r.choice(np.array([-1, 1], np.float32), (ROWS, NONZERO))
    return out / np.sqrt(NONZERO)


def word_vectors(texts: Iterable[str], rows: Rows) -> np.ndarray:
    """Index vectors plus the normalised context vectors that ``texts`` give."""
    own = index_vectors()
    context, held, n = np.zeros((ROWS, DIM), np.float32), [], 0

    def add():
        r = np.concatenate(held)
        near = np.zeros((len(r), DIM), np.float32)
        for k in range(1, WINDOW + 1):
            near[k:] += own[r[:-k]]
            near[:-k] += own[r[k:]]
        for d in range(DIM):
            context[:, d] += np.bincount(r, near[:, d], ROWS)

    for t in texts:
        code = rows.of(t.split())
        held.append((code & 0xFFFF).astype(np.int64))
        n += len(code)
        if n > 50_000:
            add()
            held, n = [], 0
    if n > 2 * WINDOW:
        add()
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    context += own
    return context


def pooled(text: str | None, vectors: np.ndarray, rows: Rows) -> np.ndarray:
    """The document's vector: the mean of its words' vectors, and four figures."""
    out = np.zeros(DIM + 4, np.float32)
    tokens = text.split() if text else []
    if tokens:
        count = Counter(tokens)
        code = rows.of(count)
        w = np.fromiter(count.values(), np.float32, len(count))
        n = len(tokens)
        # w @ (A + B + C) over the three rows of each token
        out[:DIM] = sum(w @ vectors[(code >> s) & 0xFFFF] for s in (0, 16, 32)) / n
        out[DIM:] = np.log1p(n), len(count) / n, sum(map(eq, tokens, tokens[1:])) / n, w.max() / n
    return out


class Network:
    """tanh layer, then a logistic unit; trained by Adam on the log loss."""

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = (x - self.mean) / self.scale
        self.p = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 128):
                b = order[i : i + 128]
                h = np.tanh(x[b] @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[b]) / len(b)
                back = np.outer(e, self.p[2]) * (1 - h * h)
                grads = [x[b].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ e + 1e-4 * self.p[2], np.array([e.sum()])]
                step += 1
                for a, g, mi, vi in zip(self.p, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    a -= 0.003 * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        """The temperature with the least log loss on rows kept from ``fit``."""
        z = self.logit(x)
        loss = lambda t: float(np.logaddexp(0, np.where(y > 0, -z, z) / t).mean())
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


class Constant:
    def __init__(self, p: float):
        self.p = p

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def fitted(texts: pa.ChunkedArray, y: np.ndarray):
    """Word vectors and network from texts and their labels."""
    if len(set(y > 0)) < 2 or len(y) < 20:
        return np.zeros((ROWS, DIM), np.float32), Constant(float((y > 0).mean()) if len(y) else 0.5)
    memory = Rows()
    vectors = word_vectors((t.as_py() for t in texts), memory)
    x = np.stack([pooled(t.as_py(), vectors, memory) for t in texts]).astype(float)
    y = (y > 0).astype(float)
    kept = np.arange(len(y)) % 5 == 0
    return vectors, Network().fit(x[~kept], y[~kept]).calibrate(x[kept], y[kept])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS):
    """Word vectors and network from at most ``rows`` labelled rows that aren't held out; a task fits them, the driver gets the model alone."""
    known = thinned(labels.select("doc_id", "quality"), 4 * rows, "doc_id")
    known = known.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    own = docs.select(F.col("doc_id").alias("_doc"), F.substring("text", 1, chars).alias("text")).where("text is not null")
    # at most `rows` rows of two numbers: safe to broadcast
    got = own.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("_id", "_y", "text")

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality", None, bool)
        if own := [p for p in parts if len(p)]:
            t = pa.Table.from_batches(own).sort_by([(c, "ascending") for c in ("_id", "_y", "text")])
            yield pa.record_batch([pa.array([pickle.dumps(fitted(t.column("text"), t.column("_y").to_numpy()), 5)], pa.binary())], ["model"])
            del t, own
        give_back()

    # the limit leaves one partition, so one task has all rows
    model = got.orderBy(F.xxhash64("_id"), "_id", "_y", "text").limit(rows).mapInArrow(task, "model binary").first()
    return pickle.loads(model["model"]) if model else fitted(pa.chunked_array([], pa.string()), np.zeros(0))


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with _score (double) and _good (score at least 0.5), which replace any columns of those names."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    vectors, net = train(docs, labels, rows)
    trim_driver(spark)
    shared = spark.sparkContext.broadcast((vectors, net))

    @F.arrow_udf("double")
    def rate(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors, net = shared.value
        memory, since = held("quality", "rows", Rows), 0
        try:
            for p in parts:
                n, out = sizes(p), [np.zeros(0)]
                for a, b in spans(n):
                    x = np.stack([pooled(t.as_py(), vectors, memory) for t in p.slice(a, b - a)])
                    out.append(net.probability(x.astype(float)))
                since += sum(n)
                del p
                if since >= EVERY:
                    since = 0
                    give_back()
                yield pa.array(np.concatenate(out))
        finally:
            give_back()

    scored = docs.withColumn("_score", rate("text"))
    return scored.withColumn("_good", F.col("_score") >= 0.5)
