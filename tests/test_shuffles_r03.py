"""keywords shuffle texts once, not every token."""

from clausespark.operators.retrieval import keywords


def test_keywords_shuffle_texts_once(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta gamma 12 x"), (2, ""), (3, None), (4, "one two two")], "doc_id long, text string")
    out = keywords(docs, "doc_id", "text", 2)
    assert sorted(map(tuple, out.collect())) == [(1, "alpha", 1, 2), (1, "beta", 2, 1), (4, "one", 1, 2), (4, "two", 2, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_vectors_shuffle_texts_once(spark):
    """the encoder."""
    from clausespark.operators.encoders import hashed_vectors

    docs = spark.createDataFrame([(1, "a b a"), (1, "c"), (2, "")], "doc_id long, text string")
    out = hashed_vectors(docs, "doc_id", "text", 8)
    rows = out.collect()
    assert [r.doc_id for r in rows] == [1] and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-9
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
