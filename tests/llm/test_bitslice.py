import re
from collections import Counter
from math import floor, log

import numpy as np

from clausespark.llm import bitslice
from clausespark.llm.bitslice import Block, Tile, _pack, op12_lexical_search, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_results_on_given_and_odd_rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [None, "", " .,", "Ärger ärger STRASSE", "the " * 50_000, "same words", "same words", "the", "\x00thé x", " ".join(f"w{i}" for i in range(30_000))]
    docs += [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "same words"), (10_006, "same words")]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, None), (901, "same SAME words same"), (None, "the strasse"), (901, "same SAME words same"), (902, "nowhere"), (903, "w1 w2 w3 the")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, tile string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, slot int").repartition(2)
    assert rows(search(d, q)) == brute(docs, items)
    assert rows(search(d, q, k=3)) == brute(docs, items, 3)


def test_bounds_leave_documents_out_and_never_a_best_one():
    rng = np.random.default_rng(1)
    docs = []
    for i in range(600):
        h = np.unique(rng.integers(0, 3000, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        docs.append((i, 0, h, rng.integers(1, 40, len(h))))
    docs = [(i, int(tf.sum()), h, tf) for i, _, h, tf in docs]
    row = type("Row", (), _pack(docs))
    block = Block(row)
    query = np.unique(rng.choice(block.vocabulary, 8))
    df = np.array([sum(t in d[2] for d in docs) for t in query])
    tile = Tile(np.array([len(query)]), query, np.ones(len(query), np.int64), df, len(docs), sum(d[1] for d in docs), 5)
    assert tile.offer(block) < 300
    weight = {t: floor(1000 * log((2 * 600 + 2) / (2 * n + 1))) for t, n in zip(query.tolist(), df.tolist(), strict=True)}
    total, scores = sum(d[1] for d in docs), []
    for i, n, h, tf in docs:
        m = 75 + 25 * n * 600 // total
        scores.append((-sum(weight.get(t, 0) * (10**9 * x // (1000 * x + 12 * m)) for t, x in zip(h.tolist(), tf.tolist(), strict=True)), i))
    ids, got = tile.best[0]
    assert [(-s, i) for i, s in zip(ids.tolist(), got.tolist(), strict=True)] == sorted(scores)[:5]


def test_many_small_blocks_slots_and_tiles(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("TILE", 2), ("TASK_BYTES", 2000), ("HELD", 7), ("FAN", 2)):
        monkeypatch.setattr(bitslice, name, value)
    docs = [(i, f"a{i % 7} b{i % 3} c{i} common common") for i in range(60)]
    items = [(i, f"a{i} b1 common c{i}") for i in range(5)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(search(d, q, k=4)) == brute(docs, items, 4)


def test_empty_tables_and_registered_query(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "a"), (6, "b a")], "doc_id long, text string")
    assert search(none, items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(op12_lexical_search(spark, str(tmp_path))) == brute([(5, "a"), (6, "b a")], [(1, "a b")])


def test_slots_have_partitions_of_their_own(spark):
    """However few partitions the session has, a task gets the blocks of one slot."""
    from clausespark.tables import partition_keys

    for n in (1, 2, 7, 130):
        keys = partition_keys(spark, n)
        dealt = spark.createDataFrame([(k,) for k in keys], "key long").repartition(n, "key")
        assert len(set(keys)) == n and [len(x) for x in dealt.rdd.glom().collect()] == [1] * n


def test_texts_with_many_terms_are_cut_early(spark, monkeypatch):
    """Documents that wait for their block are bounded by their terms too."""
    from clausespark.llm import bitslice as b

    docs = spark.createDataFrame([(i, " ".join(f"t{i}x{k}" for k in range(50))) for i in range(40)], "doc_id long, text string").coalesce(1)
    assert [r.docs for r in b.blocks(docs).collect()] == [40]
    size = b.HELD_TERMS
    assert size * 16 <= 64 << 20
    got = b.blocks(spark.createDataFrame([(i, " ".join(map(str, range(size // 8)))) for i in range(9)], "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.docs for r in got) == 9 and max(r.docs for r in got) <= 8
