"""Findings F1, F3, F4 and F5: what the driver and the disk hold."""

import glob

import numpy as np
from pyspark.sql import functions as F

from clausespark.llm import jaccard, line_dedup, topk
from clausespark.tables import connected_components, stored


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_when_a_table_is_stored(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    out = stored(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    assert local and not files() - before
    assert out.count() == 1000 and files() - before


def test_lines_have_fewer_blocks_and_keep_their_links(spark):
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(200)]
    groups = spark.createDataFrame(list(enumerate(lines)), "gid long, norm string")
    # 46 before
    assert line_dedup.blocks(groups).count() / 200 < 36
    changed = []
    for i, x in enumerate(lines):
        ws = x.split(" ")
        for at in range(i % 5, 60, 5):
            ws[at] = f"new{i}-{at}"
        changed += [(i, x), (1000 + i, " ".join(ws))]
    links = line_dedup.line_links(spark.createDataFrame(changed, "gid long, norm string"))
    assert {(r.a, r.b) for r in links.collect()} == {(i, 1000 + i) for i in range(200)}


def test_top_k_merges_tiles_of_a_slot_and_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "SLOTS", 3)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 300, (200, 6)))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = topk.top_k(rows.where("vec_id % 20 = 0"), rows, k=5, scale=1.0)
    assert "Broadcast" not in plan_of(out)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    s = v @ v.T
    assert got == {q: [(int(i), int(s[q, i])) for i in sorted((i for i in range(200) if i != q), key=lambda i: (-s[q, i], i))[:5]] for q in range(0, 200, 20)}


def test_components_and_jaccard_broadcast_nothing(spark, monkeypatch):
    plans = []

    def noted(df, name):
        plans.append(plan_of(df))
        return stored(df, name)

    monkeypatch.setattr("clausespark.tables.Scratch.stored", lambda self, df, name: noted(df, name))
    connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
    texts = [" ".join(f"w{(i // 3) * 100 + j}" for j in range(60)) + " x" * (i % 3) for i in range(30)]
    jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(plans) > 10 and not [p for p in plans if "BroadcastHashJoin" in p]
