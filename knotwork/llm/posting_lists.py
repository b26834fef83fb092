"""Approximate nearest neighbours over balanced posting lists (operator 3).

Centroids come from a bounded sample. Every vector goes to the list of its nearest centroid, and a vector
near a boundary also to the lists of other centroids almost as near. A query walks an in-memory graph of
the centroids and takes the lists whose centroid is at most ``ratio`` times as far as the nearest one; that
ratio is the least that finds ``AIM`` of the true neighbours among sampled rows. Listed vectors are then
compared with the query in double precision.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with the greatest norm M, zero
for queries; so nearest centroids are those of the largest inner products, whatever the norms.

Lists that are longer than twice ``LEAF`` are split into at most ``FAN`` lists each, by centroids of their own that a task
fits to a bounded sample of the list; queries follow, with a ratio tuned on that sample. That goes on, level by level, until
no list is too long or its vectors are all equal; so lists grow in number with the input, not in length.

Scale: the sample is at most ``SAMPLE`` rows and ``SAMPLE_NUMBERS`` numbers, centroids of the first level at most
``SAMPLE / 16``: what is broadcast doesn't grow with the input. Rows and queries are dealt by ranges of lists when those are
split, so a task reads the centroids of few lists from the shared folder. Long lists are dealt out in parts of
``PART`` vectors and ``ASK`` queries, so a vector that a third of the rows repeat makes many tasks, not a
long one. Each part returns at most k rows per query, and none that score below the query's k-th best
row of the sample in its lists: those can't be among the k nearest found.

Defined cases: vectors that are null, zero, or hold a null or a number that isn't finite take no part,
neither do those of another length than the most common one; a null vec_id takes no part; a vec_id that
several rows have counts once, with its best score; equal scores go to the smaller vec_id; with fewer than
k candidates all are returned; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import Workspace, open_fs
from .worker import PIECE, guarded, held

SAMPLE, SAMPLE_NUMBERS = 20_000, 4_000_000
COPIES, BOUNDARY, AIM = 4, 1.1, 0.985
PART, ASK = 4096, 4096
LEAF, FAN, PER, LEVELS = 4096, 64, 32, 6
#: Numbers in a table of distances.
TABLE = 1 << 19


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, norm2) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine)
    common = own.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    own = own.where(F.size("embedding") == (common["d"] if common else 0))
    return own.withColumn("norm2", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _by_rows(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of ``x`` whose distances to all of ``c`` are at most ``TABLE`` numbers."""
    n = max(1, TABLE // max(1, len(c)))
    return ((i, min(i + n, len(x))) for i in range(0, len(x), n))


def balanced_centroids(x: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means whose clusters of more than twice the mean are split in two while that is possible."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        a = np.concatenate([_sq(x[i:j], c).argmin(1) for i, j in _by_rows(x, c)])
        size = np.bincount(a, minlength=len(c))
        total = np.stack([np.bincount(a, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        # an empty or least cluster's centroid moves into the largest cluster
        for big, small in zip(np.argsort(-size)[: n // 8 + 1], np.argsort(size), strict=False):
            own = x[a == big]
            if size[big] > 2 * len(x) / n and size[small] < len(x) / n / 4 and len(own) and np.ptp(own, 0).any():
                c[small] = own[r.integers(len(own))]
    return np.unique(c, axis=0)


class Centroids:
    """Centroids with a graph of near ones, for best-first search."""

    def __init__(self, points: np.ndarray, degree: int = 24):
        self.points, n = points, len(points)
        d = _sq(points, points)
        near = np.argsort(d, 1, kind="stable")[:, 1 : degree + 1]
        links: list[set[int]] = [set(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row[: degree // 2]:
                links[j].add(i)
        # a ring makes the graph connected
        for i in range(n):
            links[i].update({(i + 1) % n, (i - 1) % n} - {i})
        self.links = [np.array(sorted(x), int) for x in links]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def lists(self, q: np.ndarray, ratio: float, least: int = 1) -> list[int]:
        """Centroids at most ``ratio`` times as far as the nearest that the walk finds, and ``least`` in any case."""
        seen = set(self.entries.tolist())
        dist = lambda at: np.sqrt(((self.points[at] - q) ** 2).sum(1)).tolist()
        heap = list(zip(dist(self.entries), self.entries.tolist(), strict=True))
        heapq.heapify(heap)
        best, found = heap[0][0], []
        while heap:
            d, i = heapq.heappop(heap)
            best = min(best, d)
            if d > best * ratio and len(found) >= max(16, least):
                break
            found.append((d, i))
            fresh = [j for j in self.links[i].tolist() if j not in seen]
            seen.update(fresh)
            if fresh:
                for e, j in zip(dist(np.array(fresh)), fresh, strict=True):
                    heapq.heappush(heap, (e, j))
        found.sort()
        best = found[0][0]
        return [i for k, (d, i) in enumerate(found) if k < least or d <= best * ratio]


def _lists_of(x: np.ndarray, c: np.ndarray, copies: int = COPIES) -> np.ndarray:
    """The lists of each vector, nearest first; -1 where it has fewer than ``copies``."""
    return np.concatenate([_nearest(x[i:j], c, copies) for i, j in _by_rows(x, c)] or [np.zeros((0, min(copies, len(c))), np.int64)])


def _nearest(x: np.ndarray, c: np.ndarray, copies: int) -> np.ndarray:
    d = _sq(x, c)
    k = min(copies, len(c))
    near = np.argpartition(d, k - 1, 1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    own = np.take_along_axis(d, near, 1)
    order = np.argsort(own, 1, kind="stable")
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    return np.where(own <= own[:, :1] * BOUNDARY**2, near, -1)


def tune(x: np.ndarray, raw: np.ndarray, c: np.ndarray, k: int) -> float:
    """The least ratio at which sampled rows find ``AIM`` of their true neighbours in the sample."""
    ask = np.arange(0, len(x), max(1, len(x) // 256))
    score = raw[ask] @ raw.T
    score[np.arange(len(ask)), ask] = -np.inf
    top = np.argsort(-score, 1)[:, : min(k, len(x) - 1)]
    if not top.size:
        return 1.0
    q = np.concatenate([raw[ask], np.zeros((len(ask), 1))], 1)
    d = np.sqrt(_sq(q, c))
    d = d / np.maximum(d.min(1, keepdims=True), 1e-9)
    lists = _lists_of(x, c)[top]  # queries, neighbours, copies
    need = np.where(lists >= 0, np.take_along_axis(d, np.maximum(lists, 0).reshape(len(ask), -1), 1).reshape(lists.shape), np.inf).min(2)
    return float(np.quantile(need, AIM)) * (1 + 1e-9)


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten())
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _sent(p: pa.RecordBatch, row: np.ndarray, lists: np.ndarray, low: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ``p`` for lists, each row as often as it has lists: in batches of about ``PIECE`` bytes, as a query can be asked in most lists."""
    n = max(1, int(PIECE * len(p) / max(p.nbytes, 1)))
    for i in range(0, len(row), n):
        at = pa.array(row[i : i + n], pa.int64())
        own = {"list": pa.array(lists[i : i + n], pa.int64()), "vec_id": p.column("vec_id").take(at)}
        if low is not None:
            own["low"] = pa.array(low[i : i + n], pa.float64())
        yield pa.RecordBatch.from_pydict(own | {"embedding": p.column("embedding").take(at)})


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed coordinate by coordinate: equal vectors get equal scores."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def floor_of(scores: np.ndarray, k: int) -> float:
    """What the k-th best of ``scores`` is, less a rounding error and a few ranks; no bound where there are fewer.

    The ranks make up for rounding that puts a row on the boundary in one list here and in another there."""
    k += 4
    if len(scores) < k:
        return -np.inf
    low = np.partition(scores, -k)[-k]
    return float(low - 1e-9 * (1 + abs(low))) if np.isfinite(low) else -np.inf


def best(q_ids: np.ndarray, q: np.ndarray, low: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of ``x`` for each query, own ids and scores below ``low`` excepted: query ids, ids, exact scores."""
    out, order = [], np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    # an id that several rows have counts once, with its best score
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        s[q_ids[i : i + 256, None] == ids[None, :]] = -np.inf
        own = s if len(first) == len(ids) else np.maximum.reduceat(s, first, 1)
        cut = np.partition(own, -k, 1)[:, -k] if own.shape[1] > k else np.full(len(s), -np.inf)
        # whatever rounding could put among the k best is compared exactly
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
        a, b = np.nonzero((s >= np.maximum(cut - slack, low[i : i + 256])[:, None]) & np.isfinite(s))
        e = exact_scores(q[i + a], x[b])
        order = np.lexsort((-e, ids[b], a))
        a, b, e = a[order], b[order], e[order]
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (ids[b[1:]] != ids[b[:-1]])
        a, b, e = a[once], b[once], e[once]
        order = np.lexsort((ids[b], -e, a))
        a, b, e = a[order], b[order], e[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
        top = rank < k
        out.append((q_ids[i + a[top]], ids[b[top]], e[top]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))  # type: ignore[return-value]


def _widen(z: np.ndarray, m2: float) -> np.ndarray:
    """Rows with the coordinate that makes inner products distances."""
    return np.concatenate([z, np.sqrt(np.maximum(m2 - (z * z).sum(1, keepdims=True), 0))], 1)


def _centroids_of(folder: str, which: int) -> tuple[np.ndarray, float] | None:
    """The centroids and ratio that a list was split by, from the shared folder; None where it wasn't."""
    import pyarrow.dataset as ds

    def make():
        fs, at = open_fs(folder)
        t = ds.dataset(at, filesystem=fs, format="parquet").to_table(filter=ds.field("list") == which)
        return (_matrix(t.column("centroid").combine_chunks()), t.column("ratio")[0].as_py()) if len(t) else None

    return held("posting_lists", (folder, which), make)


def _by_list(parts: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple]:
    """Runs of rows of one list, with what it was split by."""
    for p in guarded("posting_lists", parts):
        lists = p.column("list").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(p)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield p.slice(a, b - a), int(lists[a]), _centroids_of(folder, int(lists[a]))


def refined(posted: DataFrame, asked: DataFrame, m2: float, k: int, ws: Workspace, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """``posted`` and ``asked`` with lists of over 2 * ``leaf`` rows split, level by level."""
    dealt = lambda t: t.repartitionByRange("list", "vec_id").sortWithinPartitions("list")
    post_kind, ask_kind = "list long, vec_id long, embedding array<double>", "list long, vec_id long, low double, embedding array<double>"
    stuck = None
    for level in range(LEVELS):
        big = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(f"n > {2 * leaf}")
        if stuck is not None:
            big = big.join(stuck, "list", "left_anti")
        if big.isEmpty():
            break
        # a random share, so that rows which repeat a vec_id don't come together
        some = posted.join(big, "list").where(F.rand(level) * F.col("n") < FAN * PER).select("list", "vec_id", "embedding", "n")

        def fit(t: pa.Table) -> pa.Table:
            raw = _matrix(t.column("embedding").combine_chunks())
            x = _widen(raw, m2)
            fan = int(min(FAN, max(2, -(-t.column("n")[0].as_py() // leaf)), max(1, len(x) // 4)))
            c = balanced_centroids(x, fan)
            names = ["list", "sub", "centroid", "ratio"]
            if len(c) < 2:
                c = c[:0]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * x.shape[1]), pa.array(c.ravel()))
            ratio = tune(x, raw, c, k) if len(c) else 1.0
            return pa.table([pa.array([t.column("list")[0].as_py()] * len(c), pa.int64()), pa.array(np.arange(len(c)), pa.int32()), flat, pa.array([ratio] * len(c), pa.float64())], names)

        name = f"fit-{level}"
        fits = ws.save(some.groupBy("list").applyInArrow(fit, "list long, sub int, centroid array<double>, ratio double").repartitionByRange("list").sortWithinPartitions("list", "sub"), name)
        folder = f"{ws.path}/{name}"

        def post(parts: Iterator[pa.RecordBatch], folder: str = folder) -> Iterator[pa.RecordBatch]:
            for p, which, split in _by_list(parts, folder):
                lists = np.zeros((len(p), 1), np.int64) if split is None else _lists_of(_widen(_matrix(p.column("embedding")), m2), split[0], 2)
                row, copy = np.nonzero(lists >= 0)
                yield from _sent(p, row, which * FAN + lists[row, copy])

        def ask(parts: Iterator[pa.RecordBatch], folder: str = folder) -> Iterator[pa.RecordBatch]:
            for p, which, split in _by_list(parts, folder):
                if split is None:
                    row, sub = np.arange(len(p)), np.zeros(len(p), np.int64)
                else:
                    q = _matrix(p.column("embedding"))
                    d = np.sqrt(_sq(np.concatenate([q, np.zeros((len(q), 1))], 1), split[0]))
                    row, sub = np.nonzero(d <= d.min(1, keepdims=True) * split[1])
                yield from _sent(p, row, which * FAN + sub, p.column("low").to_numpy()[row])

        if not level:
            # the bound counts sample rows that a query may not reach any more
            asked = asked.withColumn("low", F.lit(float("-inf")))
        # lists that were too long and couldn't be split have the number of their first part from now on
        whole = big.select("list").join(fits.select("list").distinct(), "list", "left_anti")
        stuck = (whole if stuck is None else whole.union(stuck)).select((F.col("list") * FAN).alias("list"))
        stuck = ws.save(stuck, f"stuck-{level}")
        posted = ws.save(dealt(posted).mapInArrow(post, post_kind), f"lists-{level}")
        asked = ws.save(dealt(asked).mapInArrow(ask, ask_kind), f"asked-{level}")
    return posted, asked


def search(vectors: DataFrame, is_query: Column, k: int, ws: Workspace, leaf: int = LEAF) -> DataFrame:
    """Each query's ``k`` nearest rows: query_id, rank, vec_id, score. ``is_query`` tells queries by vec_id."""
    spark = vectors.sparkSession
    ship(spark)
    own = ws.save(usable(vectors), "usable")
    kind = "query_id long, rank int, vec_id long, score double"
    about = own.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m2"), F.max(F.size("embedding")).alias("d")).first()
    if not about["n"]:
        return spark.createDataFrame([], kind)
    m2, most = float(about["m2"]), min(SAMPLE, max(64, SAMPLE_NUMBERS // about["d"]))
    taken = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", "embedding").toArrow()
    ids, first = np.unique(taken.column(0).to_numpy(), return_index=True)
    raw = _matrix(taken.column(1).combine_chunks())[first]
    sample = _widen(raw, m2)
    n_lists = min(max(64 if about["n"] >= 4096 else 1, about["n"] // 400), max(1, len(sample) // 16))
    c = balanced_centroids(sample, n_lists)
    ratio = tune(sample, raw, c, k)
    shared = spark.sparkContext.broadcast((Centroids(c), ids, raw, _lists_of(sample, c)))

    def post(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in guarded("posting_lists", parts):
            lists = _lists_of(_widen(_matrix(p.column("embedding")), m2), shared.value[0].points)
            row, copy = np.nonzero(lists >= 0)
            yield from _sent(p, row, lists[row, copy])

    posted = ws.save(own.mapInArrow(post, "list long, vec_id long, embedding array<double>"), "lists")
    # as many as there are centroids in memory
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, ids, raw, lists_of = shared.value
        for p in guarded("posting_lists", parts):
            q = _matrix(p.column("embedding"))
            q_ids = p.column("vec_id").to_numpy()
            rows, lists, low, n = [], [], [], 0
            for i, v in enumerate(q):
                for least in (1, 8, 64, len(g.points)):
                    got = g.lists(np.append(v, 0.0), ratio, least)
                    if sum(sizes.get(j, 0) for j in got) > (k + 1) * COPIES or least >= len(g.points):
                        break
                chosen = np.zeros(len(g.points) + 1, bool)
                chosen[got] = True
                near = np.flatnonzero(chosen[lists_of].any(1) & (ids != q_ids[i]))
                low.append(np.full(len(got), floor_of(raw[near] @ v, k)))
                lists.append(np.array(got, np.int64))
                rows.append(np.full(len(got), i))
                n += len(got)
                if n * p.nbytes >= PIECE * len(p) or i == len(q) - 1:
                    yield from _sent(p, np.concatenate(rows), np.concatenate(lists), np.concatenate(low))
                    rows, lists, low, n = [], [], [], 0

    asked = ws.save(own.where(is_query).mapInArrow(ask, "list long, vec_id long, low double, embedding array<double>"), "asked")
    posted, asked = refined(posted, asked, m2, k, ws, leaf)
    count = lambda t, name, size: t.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    parts = ws.save(count(posted, "parts", PART).join(count(asked, "asks", ASK), "list"), "parts")
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(parts, "list").withColumn("part", deal("parts")).withColumn("ask", every("asks")).drop("parts", "asks")
    right = asked.join(parts, "list").withColumn("ask", deal("asks")).withColumn("part", every("parts")).drop("parts", "asks")

    def compare(x: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(x) or not len(q):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        (q_ids, qs), (ids, xs) = ((t.column("vec_id").to_numpy(), _matrix(t.column("embedding").combine_chunks())) for t in (q, x))
        found = best(q_ids, qs, q.column("low").to_numpy(), ids, xs, k)
        return pa.table([pa.array(z) for z in found], names)

    keys = ("list", "part", "ask")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    one = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
