"""Vectors are filled in time that grows with a row's tokens, and tokens come back to their rows in one shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from clausespark.functions.text import token_runs, tokenize
from clausespark.operators.encoders import hashed_vectors, token_weights


def brute(spark, docs, dims, weights=None):
    out = {}
    for r in docs.select("doc_id", F.explode(F.flatten(token_runs("text"))).alias("t")).select("doc_id", "t", F.pmod(F.xxhash64("t"), F.lit(dims)).alias("s"), (F.pmod(F.hash("t"), F.lit(2)) == 0).alias("plus")).collect():
        x, y = out.setdefault(r.doc_id, (Counter(), Counter()))
        w = 1.0 if weights is None else weights.get(r.t, max(weights.values()))
        x[r.s] += w if r.plus else -w
        y[r.s] += w
    vectors = {}
    for i, (x, y) in out.items():
        x = x if sum(v * v for v in x.values()) ** 0.5 > 1e-12 * sum(v * v for v in y.values()) ** 0.5 else y
        vectors[i] = [x[s] / sum(v * v for v in x.values()) ** 0.5 for s in range(dims)]
    return vectors


def test_vectors_of_repeated_ids_and_odd_texts(spark):
    texts = ["alpha beta alpha", "", None, "混凝土ab 土", " x ", "ß①"] + [f"w{k} w{k + 1} 混凝{k}" for k in range(60)]
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)] + [(None, "alpha"), (None, "beta gamma")], "doc_id long, text string")
    weights = token_weights(docs.where("doc_id % 2 = 0"), "doc_id", "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # an id goes on in the next batch
    try:
        for w in (None, weights):
            got = {r.doc_id: r.embedding for r in hashed_vectors(docs, "doc_id", "text", 16, w).collect()}
            want = brute(spark, docs, 16, w and {r.token: r.weight for r in w.collect()})
            assert got.keys() == want.keys()
            assert all(abs(a - b) < 1e-9 for i in got for a, b in zip(got[i], want[i], strict=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_are_not_looked_up_slot_by_slot(spark):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    weights = token_weights(docs, "doc_id", "text").hint("merge")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "element_at" not in plan(hashed_vectors(docs, "doc_id", "text", 8))
    weighted = plan(hashed_vectors(docs, "doc_id", "text", 8, weights))
    assert "element_at" not in weighted and weighted.count("hashpartitioning(slot") == weighted.count("hashpartitioning(doc_id#0L, slot") == 0


def test_tokens_are_as_runs_have_them(spark):
    texts = ["", None, " ", "a", " A b ", "混", "混凝土", "a混凝b 土x", "a_b--c,  d", "ﬀ ① Ⅳ ſ", "😀", "x\ny\tz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all(r.a == r.b for r in df.select(tokenize("text").alias("a"), F.flatten(token_runs("text")).alias("b")).collect())
