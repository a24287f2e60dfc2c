"""The pipeline over a small table, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausespark.llm.common import documents, stored

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, DIR)
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DIR), name)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and {r.doc_id for r in rows} <= set(before)
        assert all(len(r.text) <= len(before[r.doc_id]) and r.n_chars == len(r.text) for r in rows), name
        before = {r.doc_id: r.text for r in rows}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert sorted(r.doc_id for r in last) == sorted(before)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert corpus_pipeline.quality_rules(spark, docs, DIR).join(labels.where("quality = 1"), "doc_id").count() == docs.join(labels.where("quality = 1"), "doc_id").count()


def test_odd_rows(spark):
    """Nulls in any column, repeated ids and rows, ties, and further columns with the names that stages use inside."""
    long = " ".join(f"w{i * i}" for i in range(400))
    texts = [(1, long), (2, long + " end"), (2, "an unlike text of another kind with the same id " * 2), (5, None), (6, ""), (None, long), (None, None), (7, "short"), (7, "short"), (8, "\n \n---\n---")]
    columns = ["lang", "source", "gone", "own", "doc", "h", "key", "gid", "node", "component", "gone_id", "n_lines", "t"]
    docs = documents(spark, DIR).limit(0)
    docs = docs.unionByName(spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in texts], "doc_id long, text string, n_chars long"), allowMissingColumns=True)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in columns if c not in docs.columns])
    start = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DIR), name)
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) if "text" in out.columns else out.count()
        if name == "line_dedup":
            assert out.columns == docs.columns and len(got) == len(texts) and (1, "") in got and (8, "\n \n---") in got and (5, None) in got
        elif name == "simhash_dedup":
            assert out.columns == docs.columns and {i for i, _ in got} == {1, 2, 5, 7, None, 8}, got
        if name != "packing":
            docs = out if name == "suffix_dedup" else docs
        else:
            assert out.count() == docs.count()
    kept = corpus_pipeline.simhash_dedup(spark, start, DIR).where("doc_id = 2").collect()
    assert [r.text[:9] for r in kept] == ["an unlike"]


def test_empty(spark):
    docs = documents(spark, DIR).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    pytest.importorskip("duckdb")
