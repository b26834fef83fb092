"""Benchmark decontamination with DataFrame and SQL functions alone (operator 7).

Words are runs of letters and digits in lower case. For every benchmark item, windows of the item's own
length slide over each document; a window and an item are alike where their five-word shingles, weighted
by how often they occur, have a similarity of at least 0.75 (sum of the lesser weights over sum of the
greater).

Windows and items of one length meet by SimHash. A fingerprint has ``HASHES`` * 64 bits, of the words' hashes
weighted by how often the words occur; it is cut into ``BLOCKS`` blocks, and a window meets the items that agree in a
whole block: all those within ``RADIUS`` = ``BLOCKS`` - 1 bits, and those beyond with a probability that falls
slowly (a block of 8 bits survives 15 bits of difference in a hundred more than a fourth of the time, and there are 32).
Then the whole fingerprints are compared, those more than ``FAR`` bits apart dropped, and exact similarity decides.

A window that shares no shingle with any item has similarity 0, and one that shares fewer than similarity 0.75 takes can't
reach it; such windows get no fingerprint. That loses nothing: a document's shared shingles are listed by place, and any
window that holds enough of them is cut out, wherever it starts.

Scale: one pass over the texts without an exchange. Item shingles go into the plan as literals up to
``LITERALS`` of them; beyond that they are joined, where Spark broadcasts them only below its threshold.
Only documents that share a shingle with an item are written, and cut into windows.

Defined cases: null and empty texts are clean; an item of fewer than five words is one shingle, its whole
sequence, and items without words are left out; equal items and equal windows all count; rows that repeat
doc_id and text share their finding; a null doc_id is a document like any other; other columns pass
through ``clean`` unchanged; an empty table or an empty benchmark finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh

SHINGLE, PERCENT, LITERALS = 5, 75, 20_000
#: 64-bit words of a fingerprint, its blocks, the distance within which blocks find everything, the largest one compared exactly.
HASHES, BLOCKS = 4, 32
RADIUS, FAR = BLOCKS - 1, 80


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``: a lambda's argument is computed once, whereas a
    column that the optimizer moves into another lambda is computed for each of its elements."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _words(text: str) -> str:
    return f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"


def words(text: str) -> Column:
    """The words of a column, as an array."""
    return F.expr(_words(text))


def _shingles(words: str, g: object = SHINGLE) -> str:
    """SQL for the hashes of all runs of ``g`` words."""
    return f"if(size({words}) >= {g}, transform(sequence(0, size({words}) - {g}), i -> xxhash64(slice({words}, i + 1, {g}))), array())"


def fingerprints(windows: DataFrame, keys: list[str], array: str) -> DataFrame:
    """The SimHash of each row's words (``array``): columns ``keys`` and ``bits``, an array of ``HASHES`` longs.

    A bit is set where the hashes of more than half of the words have it set. Two bits are counted in one sum."""
    h = windows.select(*keys, F.explode(array).alias("_w"))
    h = h.select(*keys, *(F.xxhash64("_w", F.lit(k)).alias(f"_h{k}") for k in range(HASHES)))
    ones = [F.sum(F.expr(f"shiftrightunsigned(_h{k}, {b}) & 4294967297L")).alias(f"_b{k}_{b}") for k in range(HASHES) for b in range(32)]
    sums = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *ones)
    half = lambda k, b, shift: f"shiftleft(cast(2 * (shiftrightunsigned(_b{k}_{b}, {shift}) & 4294967295L) > _n AS bigint), {b + shift})"
    bits = [F.expr(" | ".join(half(k, b, shift) for b in range(32) for shift in (0, 32))) for k in range(HASHES)]
    return sums.select(*keys, F.array(*bits).alias("bits"))


def _blocks() -> Column:
    """Number and value of each block of the column ``bits``."""
    width = 64 * HASHES // BLOCKS
    return F.posexplode(F.expr(f"transform(sequence(0, {BLOCKS - 1}), i -> shiftrightunsigned(bits[i * {width} div 64], i * {width} % 64) & {(1 << width) - 1}L)")).alias("block", "value")


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), g (words in a shingle), words, shingles."""
    own = benchmark.select("item_id", words("text").alias("words")).where(F.size("words") > 0)
    own = own.withColumn("n", F.size("words")).withColumn("g", F.least("n", F.lit(SHINGLE)))
    return own.withColumn("shingles", F.expr(_shingles("words", "g")))


def _doc_hashes(grams: list[int]) -> str:
    """SQL for the hashes of all runs of a text's words."""
    return _let(_words("text"), "ws", f"concat({', '.join(_shingles('ws', g) for g in grams)})")


def matches(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> DataFrame:
    """Windows like an item: _key (of the document's row), doc_id, item_id, start, n, similarity."""
    known = ws.save(items(benchmark), "items")
    grams = [r["g"] for r in known.select("g").distinct().orderBy("g").collect()]
    kind = "_key struct<a:bigint,b:bigint>, doc_id long, item_id long, start int, n int, similarity double"
    if not grams:
        return docs.sparkSession.createDataFrame([], kind)
    rows = docs.select("doc_id", _key().alias("_key"), "text")
    marks = known.select(F.explode("shingles").alias("h")).distinct()
    n_marks = known.agg(F.sum(F.size("shingles"))).first()[0]
    if n_marks <= LITERALS:
        listed = ", ".join(f"{r['h']}L" if r["h"] != -(1 << 63) else f"({r['h'] + 1}L - 1L)" for r in marks.collect())
        found = rows.where(F.expr(f"exists({_doc_hashes(grams)}, h -> h IN ({listed}))"))
    else:
        hit = rows.select("_key", F.explode(F.expr(_doc_hashes(grams))).alias("h")).join(marks, "h", "left_semi").select("_key").distinct()
        found = rows.join(hit, "_key", "left_semi")
    found = ws.save(found.select("doc_id", "_key", words("text").alias("words")), "found").dropDuplicates(["_key"])
    places = known.select("n", "g", F.explode("shingles").alias("h")).distinct()
    grams_of = F.array(*(F.struct(F.lit(g).alias("g"), F.expr(_shingles("words", g)).alias("hs")) for g in grams))
    seen = found.select("_key", F.size("words").alias("size"), F.explode(grams_of).alias("x"))
    seen = seen.select("_key", "size", F.col("x.g").alias("g"), F.posexplode("x.hs").alias("pos", "h")).join(places, ["g", "h"])
    # p: where shared shingles are; a window needs k of them, so it holds k that follow each other in p
    held = seen.groupBy("_key", "size", "n", "g").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    both = "(least(n, size) + n - 2 * g + 2)"
    held = held.withColumn("k", F.expr(f"({PERCENT} * {both} + {99 + PERCENT}) div {100 + PERCENT}")).where("k > 0 and size(p) >= k")
    runs = "filter(sequence(0, size(p) - k), i -> p[i + k - 1] - p[i] <= n - g)"
    last = "greatest(0, size - n)"
    starts = f"array_distinct(flatten(transform({runs}, i -> sequence(least({last}, greatest(0, p[i + k - 1] - n + g)), least({last}, p[i])))))"
    cut = held.select("_key", "n", "g", F.explode(F.expr(starts)).alias("start"))
    window = found.join(cut, "_key").withColumn("window", F.expr("slice(words, start + 1, n)")).drop("words")
    window = ws.save(window, "windows")
    at = ["_key", "n", "start"]
    w_prints = ws.save(fingerprints(window, at, "window"), "prints")
    i_prints = fingerprints(known, ["item_id", "n"], "words")
    pairs = w_prints.select(*at, F.col("bits").alias("w_bits"), _blocks()).join(i_prints.select("item_id", "n", F.col("bits").alias("i_bits"), _blocks()), ["n", "block", "value"])
    apart = " + ".join(f"bit_count(w_bits[{k}] ^ i_bits[{k}])" for k in range(HASHES))
    pairs = pairs.where(F.expr(f"{apart} <= {FAR}")).select(*at, "item_id").distinct()
    both = pairs.join(window, at).join(known.select("item_id", "shingles"), "item_id")
    own = f"if(size(window) >= g, {_shingles('window', 'g')}, array(xxhash64(window)))"
    like = F.expr(_let(f"array_sort({own})", "own", _let("array_sort(shingles)", "other", _let(_COMMON, "common", "common / (size(own) + size(other) - common)"))))
    return both.select("_key", "doc_id", "item_id", "start", "n", like.alias("similarity")).where(F.col("similarity") >= PERCENT / 100)


#: How many values two ascending arrays, ``own`` and ``other``, have in common, repeats counted: one walk over both.
_COMMON = """aggregate(sequence(1, size(own) + size(other)), named_struct('i', 0, 'j', 0, 'c', 0), (s, x) ->
    if(s.i >= size(own) or s.j >= size(other), s, named_struct('i', s.i + cast(own[s.i] <= other[s.j] as int),
    'j', s.j + cast(own[s.i] >= other[s.j] as int), 'c', s.c + cast(own[s.i] = other[s.j] as int))), s -> s.c)"""


def _key() -> Column:
    """128 bits that stand for a row's doc_id and text."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def _found(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> DataFrame:
    by = matches(docs, benchmark, ws).groupBy("_key")
    got = by.agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    return ws.save(got, "matches")


def report(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, item_ids (those it holds, ascending), the greatest similarity."""
    found = _found(docs, benchmark, ws)
    every = docs.select("doc_id", _key().alias("_key")).join(found, "_key", "left")
    return every.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.col("item_ids").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    key = fresh(docs, "_key")
    found = _found(docs, benchmark, ws).select(F.col("_key").alias(key))
    return docs.withColumn(key, _key()).join(found, key, "left_anti").select(*docs.columns)
