import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import words

from knotwork.llm import decontaminate, histogram_shards, near_dup, pii, quality, sp_backend, token_files
from knotwork.llm.common import Workspace

BENCH = "item_id long, text string"


def test_quality(spark, odd_docs, no_docs):
    texts = [(i, words(i, 60) if i % 3 else words(i, 40).upper().replace(" ", "!! ")) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).withColumn("held", quality.held_out(docs.doc_id)).toPandas()
    held = got[got.held]
    assert (held.held == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]).all() and len(held)
    assert (held._good == (held.doc_id % 3 > 0)).mean() > 0.95 and got._score.between(0, 1).all()
    odd = quality.score(odd_docs, labels).toPandas()
    assert len(odd) == odd_docs.count() and odd._score.notna().all() and odd[odd.doc_id.isin([5, 6, 7])]._score.nunique() == 1
    assert quality.score(no_docs, labels.limit(0)).count() == 0
    assert set(quality.score(docs, labels.limit(0)).toPandas()._score) == {0.5}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_quality_of_real_labels(spark):
    """Accuracy and order on the rows that training never sees."""
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    docs, labels = table("documents"), table("labels")
    got = quality.score(docs, labels).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("_score", "quality").toPandas()
    y, p = got.quality.to_numpy(), got._score.to_numpy()
    assert len(got) > 50 and ((p >= 0.5) == (y == 1)).mean() > 0.95
    order = p[y == 1][:, None] - p[y == 0][None, :]
    assert (order > 0).mean() + 0.5 * (order == 0).mean() > 0.98
    loss = -(np.log(np.clip(p, 1e-6, 1)) * y + np.log(np.clip(1 - p, 1e-6, 1)) * (1 - y)).mean()
    assert loss < 0.2  # probabilities, not only an order


def test_quality_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 100, words(i, 30)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 100, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    one, two = (sorted(map(tuple, quality.score(docs.repartition(n), labels, rows=40).select("doc_id", "_score").collect())) for n in (1, 5))
    assert one == two and len(one) == 200


def test_shards(spark, odd_docs, no_docs):
    for docs, n in ((odd_docs, 3), (spark.createDataFrame([(i, "same" if i < 400 else words(i, i % 50)) for i in range(1000)], "doc_id long, text string"), 8)):
        got = histogram_shards.shards(docs, n, Workspace(spark, "t")).toPandas()
        assert len(got) == docs.count()
        for s, own in got.groupby("_shard"):
            assert sorted(own._slot) == list(range(len(own))) and 0 <= s < n
        assert (got._size == [len((t or "").encode()) + 1 for t in got.text]).all()
    size = got.groupby("_shard")._size.sum()
    assert len(size) == 8 and size.max() - size.min() <= 2 * got._size.max()
    # equal texts share a shard where they fit into one
    assert got[got.text != "same"].groupby("text")._shard.nunique().max() == 1
    assert histogram_shards.shards(no_docs, 3, Workspace(spark, "t")).count() == 0


def test_shards_keep_clashing_columns(spark):
    kind = "doc_id long, text string, _h long, _d string, _piece int, _size int, _shard string, _slot long"
    docs = spark.createDataFrame([(i, words(i, 5), i, "d", 3, 4, "s", 9) for i in range(50)], kind)
    got = histogram_shards.shards(docs, 3, Workspace(spark, "t")).collect()
    assert {(r["doc_id"], r["_h"], r["_d"], r["_piece"]) for r in got} == {(i, i, "d", 3) for i in range(50)}
    assert all(r["_size"] == len(r["text"]) + 1 and r["_shard"] in (0, 1, 2) for r in got)


def brute_groups(docs):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d]) for d in sets}


def test_near_dup(spark, odd_docs, no_docs):
    import random

    r, rows = random.Random(4), []
    base = words(50, 90).split()
    for i in range(90):  # a group of near copies larger than a cold list, with edits of any share
        own = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 9))):
            own[r.randrange(90)] = f"edit{r.randrange(6)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, words(i, 60) + " " + words(99, 30)) for i in range(50)]  # a passage that many share
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dup.near_duplicates(docs, Workspace(spark, "t")).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute_groups(rows).items()}


def test_near_dup_odd(spark, odd_docs, no_docs):
    got = near_dup.near_duplicates(odd_docs, Workspace(spark, "t")).collect()
    by = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got}
    want = brute_groups([(x["doc_id"], x["text"]) for x in odd_docs.collect() if x["doc_id"] is not None])
    assert by == want | {None: (36, None)} and len(got) == odd_docs.count()
    assert by[8] == (1, 8) and by[9] == (1, 8) and by[5] == (0, 5) and by[3][1] == 1
    assert near_dup.near_duplicates(no_docs, Workspace(spark, "t")).count() == 0
    rest = near_dup.without_near_duplicates(odd_docs, Workspace(spark, "t"))
    assert rest.columns == odd_docs.columns and sorted(x["doc_id"] or 0 for x in rest.collect()) == [0, 1, 4, 5, 6, 7, 8, 10, 11]


def test_near_dup_texts_of_one_id(spark):
    a, b = words(1, 60), words(2, 60)
    rows = [(7, a), (7, b), (3, a), (9, f"{b} more"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in near_dup.near_duplicates(docs, Workspace(spark, "t")).collect())
    assert got == sorted([(3, 56, 3, True), (7, 56, 3, False), (7, 56, 7, True), (8, 0, 8, True), (9, 0, 9, True), (9, 57, 7, False)])
    rest = sorted((x["doc_id"], x["text"] or "") for x in near_dup.without_near_duplicates(docs, Workspace(spark, "t")).collect())
    assert rest == [(3, a), (7, b), (8, ""), (9, "")]
    same = docs.limit(0).union(spark.createDataFrame([(1, a), (1, f"{a} x"), (1, a)], docs.schema))
    assert near_dup.without_near_duplicates(same, Workspace(spark, "t")).count() == 1


def test_near_dup_recall_at_the_edge(spark):
    import random

    r, rows = random.Random(12), []
    for i in range(400):  # pairs of similarity 0.75 to 0.79, each over words of its own
        own = [f"p{i}w{j}" for j in range(r.randint(60, 400))]
        n = len(own) - 4
        out = n - -(-n * 150 // 175)  # shingles that either side may lose
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[: len(own) - out], *(f"q{i}w{j}" for j in range(out))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(docs, Workspace(spark, "t")).collect()}
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    linked = [i for i in range(400) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 75 * len(sets[2 * i] | sets[2 * i + 1])]
    assert len(linked) == 400 and sum(got[2 * i + 1] == 2 * i for i in linked) >= 399


def test_near_dup_common_passage(spark):
    # all share three fifths of their shingles and none is alike, but for two groups
    shared, rows = words(70, 64), []
    for i in range(120):
        rows.append((i, f"{shared} {' '.join(f'u{i % 100}x{j}' for j in range(40))}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(docs, Workspace(spark, "t")).collect()}
    assert got == {i: i % 100 for i in range(120)}


def brute_leaks(docs, items):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w, found = norm(t), set()
        for i, x in items:
            y = norm(x)
            g = min(5, len(y))
            if not y or len(w) < g:
                continue
            b = [tuple(y[j : j + g]) for j in range(len(y) - g + 1)]
            for s in range(max(1, len(w) - len(y) + 1)):
                win = w[s : s + len(y)]
                a = [tuple(win[j : j + g]) for j in range(len(win) - g + 1)]
                inter = sum(min(a.count(h), b.count(h)) for h in set(a))
                if inter / (len(a) + len(b) - inter) >= 0.75:
                    found.add(i)
        out[d] = sorted(found)
    return out


def test_decontaminate(spark, odd_docs, no_docs):
    items = [(i, words(200 + i, 15 + i)) for i in range(20)] + [(50, "Short one"), (51, ""), (52, None), (53, words(200, 15))]
    docs = [(0, words(1, 80) + " " + items[3][1].upper() + "! " + words(2, 50)), (1, words(3, 200))]
    y = items[19][1].split()
    docs += [(2, words(5, 9) + " " + " ".join([*y[:33], "edit"]) + " x"), (3, " ".join(y[:15])), (4, "a short, ONE here"), (5, items[0][1]), (6, " ".join(["q", *y[1:]]))]
    bench = spark.createDataFrame(items, BENCH)
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), bench, Workspace(spark, "t")).collect()
    want = brute_leaks(docs, items)
    assert {x["doc_id"]: list(x["item_ids"]) for x in got} == want and want[0] == [3] and want[4] == [50] and want[5] == [0, 53] and want[1] == []
    decontaminate.LITERALS, before = 0, decontaminate.LITERALS
    try:  # the plan for benchmarks too large for literals
        joined = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), bench, Workspace(spark, "t")).collect()
    finally:
        decontaminate.LITERALS = before
    assert sorted(map(str, joined)) == sorted(map(str, got))
    odd = decontaminate.clean(odd_docs, bench, Workspace(spark, "t"))
    assert odd.columns == odd_docs.columns and sorted(map(str, odd.collect())) == sorted(map(str, odd_docs.collect()))
    assert decontaminate.report(no_docs, bench, Workspace(spark, "t")).count() == 0
    assert not any(x["contaminated"] for x in decontaminate.report(odd_docs, bench.limit(0), Workspace(spark, "t")).collect())


def test_decontaminate_any_start(spark):
    import random

    r = random.Random(6)
    own = [f"w{i}" for i in range(59)]
    clean = [f"c{i}" for i in range(90)]
    items = [(0, " ".join(own)), *((i, words(300 + i, 20 + 3 * i)) for i in range(1, 12))]
    docs = [(0, " ".join([*clean[:40], *own[1:30], "x", "y", "z", *own[30:57], *clean[40:]]))]
    for d in range(1, 80):  # passages with a part cut out and words put in elsewhere
        p = r.choice(items)[1].split()
        for _ in range(r.randint(1, 2)):
            a, n = r.randrange(len(p)), r.randint(0, 4)
            p = p[:a] + p[a + n :]
            a = r.randrange(len(p))
            p = p[:a] + r.sample(clean, r.randint(0, 4)) + p[a:]
        docs.append((d, " ".join([*clean[: r.randint(0, 30)], *p, *clean[60 : 60 + r.randint(0, 30)]])))
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH), Workspace(spark, "t")).collect()
    want = brute_leaks(docs, items)
    assert want[0] == [0] and {x["doc_id"]: list(x["item_ids"]) for x in got} == want


def brute_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(x.isdigit() for x in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.RANK[s[0]]))


def test_pii_base():
    import random

    r = random.Random(9)
    for _ in range(5000):
        t = "".join(r.choice("12 -.@a+%(b)9876543210.@é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute_base(t)
    long = "a" * 200_000 + "1" * 200_000 + "@"
    assert pii.base_spans(long) == []


def test_pii(spark, odd_docs, no_docs):
    got = {x["doc_id"]: x for x in pii.find(odd_docs).collect()}
    x = got[11]
    assert (x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) == (1, 1, 1, 1)
    assert all(x["n_spans"] == len([s for s in x["spans"].split(",") if s]) for x in got.values())
    text = odd_docs.where("doc_id = 11").first()["text"]
    want = pii.joined(brute_base(text))
    assert x["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(x["spans"].split(","))
    assert got[5]["spans"] == got[6]["spans"] == got[4]["spans"] == ""
    red = pii.redact(odd_docs)
    assert red.columns == odd_docs.columns
    t = red.where("doc_id = 11").first()["text"]
    assert "@" not in t and "[EMAIL]" in t and "10.0.0.256" in t and red.where("doc_id = 4").first()["text"] == words(2, 150)
    assert pii.find(no_docs).count() == 0
    m, cuts = pii.model()
    secret = 'x token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" y'
    assert [s[0] for s in pii.all_spans(secret, m, cuts)[1]] == ["secret"]


def test_pii_precision():
    m, cuts = pii.model()
    x, y, kinds = pii.examples(77, 1200)
    p = m.probability(x)
    chosen = np.array([q >= cuts[k] for q, k in zip(p, kinds, strict=True)])
    assert y[chosen].mean() > 0.95 and chosen[y > 0].mean() > 0.85


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_pii_in_real_text(spark):
    """Trained on some documents, judged on spans planted into others, by kind."""
    texts = pii.carriers(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert len(texts) == pii.CARRIERS
    m, cuts = pii.model(texts)
    x, y, kinds = pii.examples(78, 3000, texts[2::3])
    chosen, kinds = np.array([q >= cuts[k] for q, k in zip(m.probability(x), kinds, strict=True)]), np.array(kinds)
    for k in pii.JUDGED:
        own = kinds == k
        assert y[own & chosen].mean() > 0.9 and chosen[own & (y > 0)].mean() > 0.75, k
    assert y[chosen].mean() > 0.95 and chosen[y > 0].mean() > 0.9


def test_pii_long_secrets():
    import random
    import string

    r, alnum, (m, cuts) = random.Random(5), string.ascii_letters + string.digits, pii.model()
    many = lambda cs, k: "".join(r.choice(cs) for _ in range(k))
    for n in (200, 201, 700, 5000):
        for s in (many(alnum + "+/", n), f"ey{many(alnum, 30)}.ey{many(alnum, n)}.{many(alnum + '-_', 43)}"):
            text = f'x token = "{s}" y'
            assert pii.masked(text, pii.all_spans(text, m, cuts)[1]) == 'x token = "[SECRET]" y'


def test_token_files(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ws = Workspace(spark, "t")
    manifest = token_files.write(odd_docs, path, 1, ws, length=16, file_bytes=1 << 14)
    got = sorted(token_files.read(spark, ws, manifest).collect(), key=lambda x: x["start"])
    tok, rows = Tokenizer.from_file(path), odd_docs.collect()
    ids = [x["doc_id"] for x in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(got) == len(rows)
    text, at = {x["doc_id"]: x["text"] for x in rows}, 0
    for x in got:
        own = np.array([*tok.encode(text[x["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    f = token_files.TokenFile(f"{ws.path}/tokens", manifest[-1][0])
    assert len(f.sequence(0)) == 16 and not f.sequence(0).flags.owndata and len(f.mask(len(f) - 1)) == 16
    assert sum(sum(f.mask(i).to_pylist()) for i in range(len(f))) == manifest[-1][2]
    assert token_files.read(spark, ws, token_files.write(no_docs, path, 1, Workspace(spark, "t"))).count() == 0


def _proto(pieces, kind, normalizer=b"\x18\x01\x20\x00"):
    import struct

    def field(n, data):
        return bytes([n << 3 | 2]) + _var(len(data)) + data

    def _var(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([t])) for p, s, t in pieces)
    return body + field(2, b"\x18" + bytes([kind]) + b"\x98\x02\x01") + field(3, field(1, b"identity") + normalizer)


@pytest.mark.parametrize("kind", [1, 2])
def test_sp_small_models(kind):
    import random

    import sentencepiece

    bytes_ = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    parts = ["▁", "t", "h", "e", "a", "n", "th", "he", "▁t", "the", "▁th", "▁the", "an", "▁a", "▁an"]
    data = _proto([("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *bytes_, *((p, -float(i + 1), 1) for i, p in enumerate(parts))], kind)
    ref, own, r = sentencepiece.SentencePieceProcessor(model_proto=data), sp_backend.Backend(data), random.Random(2)
    for _ in range(500):
        t = "".join(r.choice(["the", "an", "a", " ", "  ", "\n", "é", "x", "th"]) for _ in range(r.randint(0, 10)))
        ids, same = own.encode([t])
        assert [int(x) for x in np.frombuffer(ids[0], own.typecode)] == ref.encode(t) and same == [True]
        assert own.decode(ids[0]) == t


def test_sentencepiece(spark, odd_docs, no_docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    ref = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {x["doc_id"]: x["text"] or "" for x in odd_docs.collect()}
    got = sp_backend.encode(odd_docs, path).collect()
    assert len(got) == odd_docs.count() and all(list(x["ids"]) == ref.encode(text[x["doc_id"]]) and x["parity"] and x["roundtrip"] for x in got)
    crc = {x["doc_id"]: (x["n_tokens"], x["ids_crc32"]) for x in sp_backend.digests(odd_docs, path).collect()}
    assert crc == {d: (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in text.items() for i in [ref.encode(t)]}
    assert sp_backend.digests(no_docs, path).count() == 0


def test_sentencepiece_parity_of_other_models():
    import sentencepiece

    # this model squeezes spaces and has no dummy prefix: whole texts are compared
    parts = ["\u2581", "t", "h", "e", "a", "n", "th", "the", "\u2581a", "an"]
    bytes_ = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    data = _proto([("<unk>", 0.0, 2), *bytes_, *((p, -float(i + 1), 1) for i, p in enumerate(parts))], 1, b"\x18\x00\x20\x01")
    b, want = sp_backend.Backend(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the an", "  the   an ", "a", ""]
    ids, same = b.encode(texts)
    assert same == [list(np.frombuffer(i, b.typecode)) == want.encode(t) for i, t in zip(ids, texts, strict=True)] and same[0]
    b.memo.encode = lambda ts: [np.zeros(3, b.typecode).tobytes() for _ in ts]
    assert b.encode(texts[:1])[1] == [False]


def test_large_ids_beside_null(spark):
    big = 9_007_199_254_740_993
    docs = spark.createDataFrame([(big, "a.b@c.example.org"), (None, "x"), (big + 1, None)], "doc_id long, text string").coalesce(1)
    assert {x["doc_id"] for x in pii.find(docs).collect()} == {big, None, big + 1}
    ws = Workspace(spark, "t")
    manifest = token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), 1, ws)
    assert [x["doc_id"] for x in sorted(token_files.read(spark, ws, manifest).collect(), key=lambda x: x["start"])] == [None, big, big + 1]
    assert {x["doc_id"] for x in sp_backend.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()} == {big, None, big + 1}


def test_token_files_roll_over(spark):
    docs = spark.createDataFrame([(i % 5, words(i, 50)) for i in range(60)], "doc_id long, text string")
    ws = Workspace(spark, "t")
    manifest = token_files.write(docs.coalesce(1), public_tokenizers.path("word_bpe_49k.json"), 1, ws, length=32, file_bytes=1)
    got = sorted(token_files.read(spark, ws, manifest).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == sorted(i % 5 for i in range(60)) and sum(n for _, n, _ in manifest) == 60
    assert [x["start"] for x in got] == list(np.cumsum([0, *(x["n_tokens"] for x in got[:-1])]))


def test_pieces():
    import pyarrow as pa

    from knotwork.llm import worker

    batch = pa.record_batch([pa.array(["a" * 90, None, "b" * 10, "c" * 500, "", "d"])], ["text"])
    got = list(worker.pieces("t", iter([batch.slice(0, 0), batch.slice(1), batch]), "text", most=100))
    assert [p.column("text").to_pylist() for p in got] == [[None, "b" * 10], ["c" * 500], ["", "d"], ["a" * 90], [None, "b" * 10], ["c" * 500], ["", "d"]]
    assert worker.held("t", 1, list) is worker.held("t", 1, list)
    kept = worker.held("t", 1, list)
    assert worker.held("u", 1, list) is not kept and worker.held("t", 1, list) is not kept


def test_quality_is_not_trained_by_the_driver(spark, monkeypatch):
    """A task fits the model: the driver's memory doesn't hold the training texts."""
    monkeypatch.setattr(quality, "word_vectors", None)
    docs = spark.createDataFrame([(i, ("good calm words " if i % 2 else "BUY !!! now ") * 5) for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    got = quality.score(docs, labels).collect()
    assert all(r["_good"] == bool(r["doc_id"] % 2) for r in got)


def test_near_dup_joins_no_values_of_each_lead(spark, monkeypatch):
    """Common values are counted without a join, and a set's rare values come once, whatever the number of its leads."""
    plans, tables = {}, {}

    def save(self, df, name, f=Workspace.save):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        tables[name] = f(self, df, name)
        return tables[name]

    monkeypatch.setattr(Workspace, "save", save)
    passages = [words(900 + k, 60) for k in range(3)]
    rows = [(i, f"{passages[i % 3]} {passages[(i + 1) % 3]} {words(i, 30 + i % 7)}") for i in range(150)]
    near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).count()
    assert tables["hot"].count() and "Join" not in plans["hot"]
    assert tables["across"].groupBy("id").count().where("count > 1").isEmpty() and "explode(rare" in plans["open"]
