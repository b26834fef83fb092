"""The pipeline stage by stage, against brute force, and on odd rows."""

import corpus_pipeline as P
import public_tokenizers
import pytest
from knotwork.llm.common import Workspace
from tests.llm.conftest import words
from tests.llm.test_text_ops import brute_base, brute_groups, brute_leaks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, _score double, n_spans int"


def saved(spark, folder, docs, labels, benchmark):
    for name, rows, kind in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good and bad texts, copies, a benchmark passage, personal data; columns that operators use for their own."""
    item = words(900, 40)
    texts = {i: words(i, 60) if i % 3 else words(i, 40).upper().replace(" ", "!! ") for i in range(240)}
    texts |= {300: texts[4], 301: f"{texts[5]} x", 302: f"{words(7001, 30)} {item} {words(7002, 30)}", 303: f"{words(7003, 50)} write to a.b@c.example.org or +1 (555) 010-9999 {words(7004, 20)}", 304: words(8, 9000)}
    row = lambda i, t: (i, t, "en", "s", len(t), "k", 0.5, 7)
    labels = [(i, int(i % 3 > 0), 0) for i in range(240)] + [(i, 1, 0) for i in (300, 301, 302, 303, 304)]
    at = saved(spark, tmp_path_factory.mktemp("p"), [row(i, t) for i, t in texts.items()], labels, [(1, item), (2, words(901, 30))])
    return at, texts, [(1, item), (2, words(901, 30))]


def test_stages(spark, corpus):
    import sentencepiece

    at, texts, items = corpus
    docs = P.table(spark, at, "documents")
    (_, quality), (_, near), (_, clean), (_, private), (_, encode) = P.STAGES
    shown = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    good = quality(spark, docs, at)
    assert good.columns == list(P.COLUMNS)
    kept = shown(good)
    wrong = sum((i in kept) != (i % 3 > 0) for i in range(240))
    assert wrong <= 6 and all(kept[i] == texts[i] for i in kept)
    one = near(spark, good, at)
    groups = brute_groups(kept.items())
    assert one.columns == list(P.COLUMNS) and shown(one) == {d: kept[d] for d, (_, c) in groups.items() if c == d}
    assert 300 not in shown(one) and 301 not in shown(one)
    left = clean(spark, one, at)
    leaks = brute_leaks(shown(one).items(), items)
    assert left.columns == list(P.COLUMNS) and shown(left) == {d: t for d, t in shown(one).items() if not leaks[d]} and 302 not in shown(left)
    masked = private(spark, left, at)
    assert masked.columns == list(P.COLUMNS)
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"]) and not brute_base(r["text"])
        assert r["doc_id"] == 303 or r["text"] == texts[r["doc_id"]]
    assert "[EMAIL]" in shown(masked)[303] and "[PHONE]" in shown(masked)[303]
    ref = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r["doc_id"]: list(r["ids"]) for r in encode(spark, masked, at).collect()}
    assert ids == {d: ref.encode(t) for d, t in shown(masked).items()}
    assert {r["doc_id"]: list(r["ids"]) for r in P.run(spark, at).collect()} == ids


def test_odd_rows(spark, tmp_path):
    at = saved(spark, tmp_path, [(None, "no id", None, None, None, None, None, None), (1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "k", 0.0, 1), (2, "", "en", "s", 0, "k", 0.0, 1), (3, "x" * 300_000, "en", "s", 9, "k", 0.0, 1)], [(None, 1, 0), (1, None, 0), (3, 1, 0)], [(None, None), (1, "")])
    got = {r["doc_id"]: r["n_tokens"] for r in P.run(spark, at).collect()}
    assert set(got) == {None, 1, 2, 3} and got[1] == got[2] == 0 and got[3] > 0


def test_empty_tables(spark, tmp_path):
    assert P.run(spark, saved(spark, tmp_path, [], [], [])).count() == 0


def test_the_order_of_stages():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dup", "decontaminate", "pii", "sentencepiece"] and P.ORACLE_SQL is None


def test_saving_returns_the_drivers_freed_memory(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def held():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Pss_Anon:")) / 1024

    ws = Workspace(spark, "trim")
    for i in range(8):
        ws.save(spark.range(3), f"before-{i}")
    jvm.System.gc()
    own = [jvm.java.util.zip.Deflater() for _ in range(3000)]
    # what lies between blocks still in use stays with the allocator, unless it is told to return it
    for i, d in enumerate(own):
        if i % 20:
            d.end()
    freed = held()
    ws.save(spark.range(3), "after")
    now = held()
    for d in own[::20]:
        d.end()
    # freed are some 240 MB; the heap may change by less meanwhile
    assert now < freed - 100, (freed, now)
