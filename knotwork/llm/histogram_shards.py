"""Histogram sort into shards of equal bytes (operator 4).

Rows are ordered by (hash of the text, doc_id), which puts equal texts side by side. Splitters of that
order are found by counting: every round, each partition counts the exact bytes below all candidate
boundaries, and the driver narrows each splitter's bracket to the two candidates around its target.
Probes first divide the range of the hash, so a shard's edge falls between groups of equal texts; only
where one group is larger than the tolerance does its bracket close on a single hash and the probes divide
that group's doc_ids. Once every splitter is within tolerance the rows are exchanged, once.

Law: ``bytes``. Splitters also cut each shard into pieces, so that tasks are not as few as shards; a row's
slot is the exact count of its shard's rows in earlier pieces plus its place in its own.

Scale: rounds read a table of three numbers per row. What reaches the driver is one row per candidate
(splitters x ``PROBES``), whatever the input. A group of copies of any size is cut by doc_id.

Defined cases: null and empty texts count one byte and share the crc 0; a null doc_id sorts first; rows
that repeat both text and doc_id can't be told apart and stay in one piece, in an arbitrary order; an
empty table gives no row; other columns pass through ``shards`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import Workspace, fresh, utf8_size

#: Candidates for each splitter and round; share of a shard's bytes that an edge may be off; pieces per shard.
PROBES, TOLERANCE, PIECES = 24, 0.002, 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

Key = tuple[int, int]


def _below(bounds: list[Key], h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the sorted ``bounds`` are at or below each key."""
    hs, ds = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))
    lo, hi = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
    tied = np.flatnonzero(lo < hi)
    for v in np.unique(h[tied]):
        at = tied[h[tied] == v]
        a, b = lo[at[0]], hi[at[0]]
        lo[at] = a + np.searchsorted(ds[a:b], d[at], "right")
    return lo


def _histogram(keys: DataFrame, bounds: list[Key]) -> list:
    """(bucket, bytes, rows, least and greatest key) of each bucket between ``bounds`` that has rows."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                g = p.assign(b=_below(bounds, p["h"].to_numpy(), p["d"].to_numpy())).sort_values(["b", "h", "d"]).groupby("b")
                yield g.agg(size=("s", "sum"), n=("s", "size"), h0=("h", "first"), d0=("d", "first"), h1=("h", "last"), d1=("d", "last")).reset_index()

    own = keys.mapInPandas(count, "b int, size long, n long, h0 long, d0 long, h1 long, d1 long")
    low, high = F.min(F.struct("h0", "d0")).alias("low"), F.max(F.struct("h1", "d1")).alias("high")
    got = own.groupBy("b").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), low, high).collect()
    return sorted((r["b"], r["size"], r["n"], tuple(r["low"]), tuple(r["high"])) for r in got)


def _probes(lo: Key, hi: Key, k: int) -> list[Key]:
    """Both ends, what follows ``hi``, and about ``k`` keys between: over the hashes, or over one hash's doc_ids."""
    i = 0 if lo[0] < hi[0] else 1
    span = hi[i] - lo[i]
    steps = {lo[i] + max(1, span * j // k) for j in range(1, k)}
    return [lo, hi, (hi[0], min(hi[1] + 1, _HIGH)), *((x, _LOW) if i == 0 else (lo[0], x) for x in steps)]


def splitters(keys: DataFrame, n: int, tolerance: int, every: int = 1, loose: int = 0) -> tuple[list[Key], int, int]:
    """``n - 1`` keys that cut ``keys`` (h, d, s) into runs of equal bytes, each ``every``-th edge within
    ``tolerance`` bytes of its target, the others within ``loose``, or at the nearest possible place; the
    total of bytes; the rounds it took."""
    first = _histogram(keys, [])
    if not first:
        return [], 0, 0
    _, total, _, low, high = first[0]
    targets = [total * i // n for i in range(1, n)]
    best: list[tuple[int, Key]] = [min((t, low), (total - t, (_HIGH, _HIGH))) for t in targets]
    allowed = [loose if i % every else tolerance for i in range(1, n)]
    brackets: list[tuple[Key, Key] | None] = [(low, high) if off > most else None for (off, _), most in zip(best, allowed, strict=True)]
    rounds = 0
    while any(brackets):
        rounds += 1
        bounds = sorted({p for b in brackets if b for p in _probes(*b, PROBES)})
        got, below, at = _histogram(keys, bounds), 0, {}
        for b, size, _, lo, hi in got:
            at[b] = (below, lo, hi)
            below += size
        known = sorted(at)
        for i, t in enumerate(targets):
            if not brackets[i]:
                continue
            # the bucket that holds the target: its first key is a boundary with a known count, and so is the next one's
            k = max(j for j, b in enumerate(known) if at[b][0] <= t)
            start, lo, hi = at[known[k]]
            best[i] = min(best[i], (t - start, lo))
            if k + 1 < len(known):
                end, nxt, _ = at[known[k + 1]]
                best[i] = min(best[i], (end - t, nxt))
            brackets[i] = (lo, hi) if best[i][0] > allowed[i] and lo < hi and brackets[i] != (lo, hi) else None
    return sorted(k for _, k in best), total, rounds


def shards(docs: DataFrame, n: int, ws: Workspace, pieces: int = PIECES) -> DataFrame:
    """``docs`` with shard (0 to n - 1) and slot (gapless from 0 in each shard), dealt and sorted by shard
    and slot; new columns: _size, _shard, _slot, which replace any of those names."""
    docs = docs.drop("_size", "_shard", "_slot")
    h, d, at = (fresh(docs, x) for x in ("_h", "_d", "_piece"))
    keyed = docs.select(
        "*",
        (utf8_size(F.col("text")) + 1).alias("_size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(h),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias(d),
    )
    keys = ws.save(keyed.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col("_size").alias("s")), "keys")
    total = keys.agg(F.sum("s")).first()[0] or 0
    m = n * pieces
    bounds, _, _ = splitters(keys, m, int(total / n * TOLERANCE), pieces, total // m // 8)
    counts = {b: k for b, _, k, _, _ in _histogram(keys, bounds)} if bounds else {}
    # a cut that several targets share leaves empty pieces between its copies, so piece i always belongs to shard i // pieces
    before, offsets = 0, []
    for i in range(m):
        before = before if i % pieces else 0
        offsets.append(before)
        before += counts.get(i, 0)

    @pandas_udf("int")
    def piece(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_below(bounds, h.to_numpy(), d.to_numpy()).astype(np.int32))

    cut = keyed.withColumn(at, piece(h, d) if bounds else F.lit(0))
    dealt = cut.repartitionById(m, F.col(at)).sortWithinPartitions(at, h, d)
    # all rows of a piece are in one partition and sorted, so the row's place is a running number there
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    start = F.element_at(F.array(*map(F.lit, offsets)), F.col(at) + 1)
    return dealt.select(*docs.columns, "_size", F.floor(F.col(at) / pieces).cast("int").alias("_shard"), (place + start).cast("long").alias("_slot"))
