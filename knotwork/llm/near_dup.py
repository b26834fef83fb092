"""Near-duplicates by bottom-k sketches of one hash function (operator 6).

A document's set is that of its distinct five-word shingles; its sketch, the ``K`` least hashes. Equal
sets make one class, so exact copies are never paired. Inverted lists of the retained values propose
pairs of classes; the sketch of a pair's union estimates its similarity and drops unlikely pairs; the full
sets confirm each remaining one at 100 * intersection >= 75 * union.

How lists propose pairs without pairing everything that shares something common: a value in at most ``COLD``
classes pairs them all. A pair without a common cold value shares hot ones alone, so it can only link if
hot values are at least three quarters of both sets; classes with that many in their sketch (``HOT_SHARE``,
below 0.75 by over three standard deviations) are matched within hot lists, where each list's leader meets
all its members. What leaders leave outside their component is then matched exactly, without a pair table: every
member takes so many of its rarest values that it shares one with each set it could link to; members that share
none with another component are done; the others are compared full set by full set, in blocks.

Scale: sketches have ``K`` numbers a document. List sizes come from partial aggregates; hot values and
large classes are joined with skew handling. Full sets are only built for documents in likely pairs.
Components are found by star rounds. The driver gets counts alone, and ``SLOTS`` counters.

Defined cases: null and empty texts and texts of white space have the empty set, link with nothing and are
kept; a null doc_id links with nothing, and its component and kept are null; rows that repeat a doc_id are a document
for each distinct text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import Workspace, fresh
from .components import components
from .shingling import shingles
from .worker import give_back, guarded, held, pieces

WORDS, PERCENT = 5, 75
K, USED, COLD, LIKELY, HOT_SHARE = 64, 32, 32, 0.5, 0.55
#: Rows and bytes of full sets in a block, slots of the counters that order values by rarity.
BLOCK, BLOCK_BYTES, SLOTS = 512, 4 << 20, 1 << 16


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n (size of the set), mark (digest of the set), sketch."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces("near_dup", parts, "text"):
            n, marks, least = [], [], []
            for t in p.column("text"):
                s = _set(t)
                n.append(len(s))
                marks.append(hashlib.blake2b(s, digest_size=16).digest())
                least.append(s[:K].copy())
            at = np.cumsum([0, *map(len, least)]).astype(np.int32)
            flat = np.concatenate(least).view(np.int64)
            own = [p.column("doc_id"), p.column("text_hash"), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            yield pa.record_batch(own, ["doc_id", "text_hash", "n", "mark", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(task, "doc_id long, text_hash long, n long, mark binary, sketch array<long>")


def _set(text: pa.StringScalar) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    b = text.as_buffer()
    return shingles(b.to_pybytes().lower(), WORDS) if b else np.zeros(0, np.uint64)


def full_sets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (id, mark, text) whose set has that mark: id, set (its hashes, ascending, as bytes)."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces("near_dup", parts, "text"):
            ids, sets = [], []
            for i, mark, t in zip(p.column("id").to_pylist(), p.column("mark").to_pylist(), p.column("text"), strict=True):
                s = _set(t)
                if hashlib.blake2b(s, digest_size=16).digest() == mark:
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    return docs.select("id", "mark", "text").mapInArrow(task, "id long, set binary")


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sketches: the share of the K least values of their union that both have."""
    least = np.union1d(x, y)[:K]
    return float((np.isin(least, x, assume_unique=True) & np.isin(least, y, assume_unique=True)).sum() / max(1, len(least)))


def _unsigned(values) -> np.ndarray:
    return np.asarray(values).view(np.uint64)


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches are likely of similar sets."""
    sk = sets.select("id", "n", "sketch")
    both = pairs.join(sk.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    # sizes alone rule out what can't reach the similarity
    both = both.join(sk.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    both = both.where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in guarded("near_dup", parts):
            (x, i), (y, j) = (_rows(p.column(c)) for c in ("sa", "sb"))
            like = [estimate(_unsigned(x[a:b]), _unsigned(y[c:d])) >= LIKELY for a, b, c, d in zip(i, i[1:], j, j[1:], strict=False)]
            yield p.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def _rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's start and end."""
    at = np.asarray(lists.offsets)
    return np.asarray(lists.flatten()), at - at[0]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets (``sets``: id, set) reach the similarity."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in guarded("near_dup", parts):
            out = [_alike(_hashes(x), _hashes(y)) for x, y in zip(p.column("sa"), p.column("sb"), strict=True)]
            yield p.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def _hashes(x: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _find(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def common_slots(sets: DataFrame) -> np.ndarray:
    """How many values of ``sets`` (id, set) fall into each of ``SLOTS`` slots: what is sent here has that bound."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for p in pieces("near_dup", parts, "set"):
            for x in p.column("set"):
                total += np.bincount((_hashes(x) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in sets.select("set").mapInArrow(task, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def with_rarest(sets: DataFrame, slots: np.ndarray) -> DataFrame:
    """``sets`` (id, set) with ``rare``: so many of a set's rarest values that it shares one of them with every set it links to.

    A set of n values has ceil(n * PERCENT / 100) at least in common with any such set; so, in one order of all values,
    the first n - ceil(n * PERCENT / 100) + 1 of both sets meet. The order is by ``slots``, then by value."""
    shared = sets.sparkSession.sparkContext.broadcast(slots)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces("near_dup", parts, "set"):
            rare = []
            for x in p.column("set"):
                h = _hashes(x)
                k = len(h) - -(-len(h) * PERCENT // 100) + 1
                rare.append(h[np.lexsort((h, shared.value[(h % np.uint64(SLOTS)).astype(np.int64)]))[:k]])
            at = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            yield pa.record_batch([p.column("id"), p.column("set"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rare).view(np.int64)))], ["id", "set", "rare"])

    return sets.select("id", "set").mapInArrow(task, "id long, set binary, rare array<long>")


def residual(rest: DataFrame, members: DataFrame) -> DataFrame:
    """Links of ``rest`` with ``members`` (lead, id, root, set, rare) of the same lead but another component.

    A lead's members are dealt into blocks of about ``BLOCK_BYTES`` of sets; every block meets that lead's rest, in blocks too.
    An index of a block's rarest values proposes, full sets decide; of the links found only those are returned that join
    components which the block's other links don't, so a block returns fewer rows than it has members."""
    kind, n = "a long, b long", 4 * rest.sparkSession.sparkContext.defaultParallelism
    cut = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("set")) / BLOCK_BYTES)).cast("int")
    size = rest.groupBy("lead").agg(cut().alias("k_r")).join(members.groupBy("lead").agg(cut().alias("k_m")), "lead")
    own = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    keys = ("lead", "i", "j")
    # names of their own, as both sides may come from one frame
    rest = rest.select("lead", "id", "root", "set", "rare").toDF("lead", "id", "root", "set", "rare")
    left = rest.join(size, "lead").withColumn("i", own("k_r")).withColumn("j", every("k_m")).select(*keys, "id", "root", "set", "rare").repartition(n, *keys)
    right = members.join(size, "lead").withColumn("j", own("k_m")).withColumn("i", every("k_r")).select(*keys, "id", "root", "set", "rare").repartition(n, *keys)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        held("near_dup", None, bool)
        out, parent = [], {}
        if len(x) and len(y):
            x, y = (t.combine_chunks().to_batches()[0] for t in (x, y))
            sets, ids, roots = [_hashes(s) for s in y.column("set")], y.column("id").to_numpy(), y.column("root").to_numpy()
            sizes = np.array([len(s) for s in sets])
            values, at = _rows(y.column("rare"))
            owner = np.repeat(np.arange(len(y)), np.diff(at))
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            rare, at = _rows(x.column("rare"))
            for i, root, s, a, b in zip(x.column("id").to_pylist(), x.column("root").to_pylist(), x.column("set"), at, at[1:], strict=False):
                s = _hashes(s)
                lo, hi = np.searchsorted(values, rare[a:b], "left"), np.searchsorted(values, rare[a:b], "right")
                near = np.unique(np.concatenate([owner[u:v] for u, v in zip(lo, hi, strict=True) if u < v] or [owner[:0]]))
                near = near[(roots[near] != root) & (100 * np.minimum(sizes[near], len(s)) >= PERCENT * np.maximum(sizes[near], len(s)))]
                for j in near.tolist():
                    p, q = _find(parent, root), _find(parent, int(roots[j]))
                    # what other links of this block join already needs no comparison
                    if p != q and _alike(s, sets[j]):
                        parent[p] = q
                        out.append((min(i, int(ids[j])), max(i, int(ids[j]))))
        give_back()
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, kind)


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set): the full sets of the classes in ``wanted`` (id)."""
    marks = wanted.join(classes.select("id", "doc", "mark"), "id")
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(marks, "doc")
    # a repeated doc_id can have other texts: the digest tells which one is the class's
    return full_sets(own).dropDuplicates(["id"])


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The links among candidate ``pairs`` of ``classes``."""
    close = ws.save(likely(pairs, classes), f"{name}-likely")
    wanted = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    sets = ws.save(_sets(docs, classes, wanted), f"{name}-sets")
    return ws.save(confirmed(close, sets), f"{name}-links")


def _groups(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n (size of its set), component."""
    ship(docs.sparkSession)
    sk = ws.save(sketches(docs), "sketches")
    # a class is a distinct set; its number is that of its row in the written table
    classes = sk.where("n > 0 and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = ws.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    listed = classes.select("id", F.size("sketch").alias("size"), F.posexplode("sketch").alias("rank", "value"))
    counts = listed.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = ws.save(listed.join(counts, "value"), "shared")
    cold = shared.where(f"df <= {COLD}")
    # the USED least cold values of each class are enough: linked classes share most of them
    cold = cold.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "value"))), 1, USED).alias("own"))
    cold = cold.select("id", F.explode("own.value").alias("value"))
    pairs = cold.withColumnRenamed("id", "a").join(cold.withColumnRenamed("id", "b"), "value").where("a < b").select("a", "b")
    # classes that could link over hot values alone, and each hot list's least one of them
    hot = shared.where(f"df > {COLD}").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))  # at most K rows each
    hot = ws.save(hot.where(f"_n >= {HOT_SHARE} * size").select("id", "value"), "hot")
    leads = hot.groupBy("value").agg(F.min("id").alias("lead"))
    stars = ws.save(hot.join(leads, "value").select("lead", "id").distinct(), "stars")
    pairs = pairs.union(stars.where("lead <> id").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))).distinct()
    links = _linked(docs, classes, pairs, ws, "first")
    roots = components(links, ws, "first")
    if not stars.isEmpty():
        # leads of one component have their members in common from here on
        root_of = lambda t, c: t.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"_{c}")), c, "left").withColumn(f"{c}_root", F.coalesce(f"_{c}", c)).drop(f"_{c}")
        members = root_of(root_of(stars, "lead"), "id").select(F.col("lead_root").alias("lead"), "id", F.col("id_root").alias("root")).distinct()
        members = ws.save(members, "members")
        outside = members.where("root <> lead").select("lead").distinct()
        # a lead that many share spreads over tasks before its members' values are taken apart
        near = members.join(outside, "lead", "left_semi").repartition("id")
        sets = ws.save(_sets(docs, classes, near.select("id").distinct()), "hot-sets")
        sets = ws.save(with_rarest(sets, common_slots(sets)), "rarest")
        # a member shares a rare value with every set it links to; without one in another component it has no link left. Each set's
        # values are held against all components once, and only what two of them have is held against those of each lead
        own = near.select("id", "root").distinct().join(sets.select("id", "rare"), "id").select("id", "root", F.explode("rare").alias("value"))
        two = own.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
        own = own.join(two, "value", "left_semi").groupBy("id").agg(F.collect_list("value").alias("rare"))
        tokens = near.join(ws.save(own, "across"), "id").select("lead", "id", "root", F.explode("rare").alias("value"))
        across = tokens.groupBy("lead", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("lead", "value")
        open_ = ws.save(tokens.join(across, ["lead", "value"], "left_semi").select("lead", "id", "root").distinct(), "open")
        near = ws.save(open_.join(sets, "id"), "near")
        more = ws.save(residual(near.where("root <> lead"), near).distinct(), "second-links")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links, ws, "second")
    of = classes.select("id", "mark", "doc").join(roots, "id", "left").select("mark", "doc", F.coalesce("root", "id").alias("root"))
    least = of.groupBy("root").agg(F.min("doc").alias("component"))
    of = of.join(least, "root").select("mark", "component")
    every = sk.join(of, "mark", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id"))).alias("component")
    return every.select("doc_id", "text_hash", "n", component)


def near_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    c = F.col("component")
    return _groups(docs, ws).select("doc_id", F.col("n").alias("n_shingles"), c.alias("component_id"), (c == F.col("doc_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with one document of each group: the one with the least doc_id. Rows without a doc_id all stay.

    Should that doc_id have several rows in the group, the text with the least hash stays, once; of rows without words that
    repeat a doc_id and text, one stays."""
    found = ws.save(_groups(docs, ws), "found")
    key, at = fresh(docs, "_doc"), fresh(docs, "_hash")
    gone = found.where("component <> doc_id").select(F.col("doc_id").cast("long").alias(key), F.col("text_hash").alias(at)).distinct()
    rows = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(at, _text_hash())
    rest = rows.join(ws.save(gone, "gone"), [key, at], "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return rest.select(*docs.columns)
    more = found.where("component = doc_id and n > 0").groupBy("component").agg(F.min("text_hash").alias("least"))
    more = found.where("component = doc_id and n > 0").join(more, "component").where("text_hash <> least").select(F.col("doc_id").alias(key), F.col("text_hash").alias(at)).distinct()
    rest = rest.join(ws.save(more, "more"), [key, at], "left_anti")
    return rest.where(F.col(key).isNotNull()).dropDuplicates([key, at]).unionByName(rest.where(F.col(key).isNull())).select(*docs.columns)


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))
