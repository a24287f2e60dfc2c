"""Odd rows and sizes at which queries differed from their SQL."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from clausespark.functions import text as T
from clausespark.operators import quality as Q
from clausespark.operators.encoders import hashed_vectors
from clausespark.plans import registry

registry.load()


def against_sql(spark, tmp_path, query, name, rows):
    """Whether a query gives what its SQL gives on a table of few rows."""
    rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    q = con.execute(registry.oracle_sql()[query])
    names = [x[0] for x in q.description]
    got = [tuple(r[c] for c in names) for r in registry.queries()[query](spark, str(tmp_path)).collect()]
    return sorted(got, key=repr) == sorted(q.fetchall(), key=repr)


def test_references_without_semicolon_and_across_tags(spark, tmp_path):
    pages = ["<title>a &amp</title><style>p{x}</style>", "<p>a &am</p><b>&am</b>p; x &amp; y</p>", "<title>R&ampD</title>\n<p>&copy; &quot;z&quot;</p>", "a &am<i>p;</i>", None]
    df = spark.createDataFrame([(i, f"http://x/{i}", p) for i, p in enumerate(pages[:3] + pages[4:])], "page_id long, url string, html string")
    for q in ("b1_strip_html", "b2_plain_text", "b7_search_text", "b10_summary"):
        assert against_sql(spark, tmp_path / q, q, "pages", df.where("page_id <> 1 AND html IS NOT NULL")), q
    got = spark.createDataFrame([(p,) for p in pages], "x string").select(T.strip_html("x").alias("t"), T.strip_html("x", closed=True).alias("c")).collect()
    # as a parser that reads each stretch between tags by itself
    assert [r.t for r in got] == ["a &p{x}", "a &am\n&amp; x & y", 'R&D\n© "z"', "a &amp;", ""]
    assert [r.c for r in got] == ["a &ampp{x}", "a &am\n&amp; x & y", 'R&ampD\n© "z"', "a &amp;", ""]


def test_ages_with_parts_of_seconds(spark, tmp_path):
    times = ["2024-01-31 23:29:59.500", "2024-01-31 23:30:00", "2024-01-31 23:29:59.999999", "2024-01-30 23:59:59.250", "2024-01-31 00:00:00", "2024-02-02 00:00:00.5"]
    df = spark.createDataFrame([(i * 3 + k + 1, t, e) for i, t in enumerate(times) for k, e in enumerate(("view", "error", "click"))], "event_id long, t string, event_type string")
    df = df.select("event_id", "event_type", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert against_sql(spark, tmp_path, "h10_task_disposition", "events", df)


def test_places_of_ranges_that_are_cut_anew(spark):
    """Rows that come in another order when their step runs again are cut elsewhere by then; places stay those of one run."""
    rows = spark.range(0, 40_000, 1, 8).select(((F.col("id") * 7919) % 40_009).alias("k"), F.when(F.rand() < 2, F.col("id")).alias("id")).repartition(16)
    got = Q.numbered(rows, [F.asc("k")], "place").select("k", "place").orderBy("k").collect()
    assert [r.place for r in got] == list(range(1, 40_001))


def test_tokens_that_cancel(spark):
    """Two tokens of one slot and unlike signs still make a vector of length 1."""
    t = spark.range(400).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"))
    t = t.select("token", F.pmod(F.xxhash64("token"), F.lit(64)).alias("slot"), F.pmod(F.hash("token"), F.lit(2)).alias("sign")).collect()
    a, b = next((x, y) for x in t for y in t if x.slot == y.slot and x.sign < y.sign)
    df = spark.createDataFrame([(1, f"{a.token} {b.token}"), (2, f"{a.token} {b.token} {a.token}"), (3, "")], "doc_id long, text string")
    weights = spark.createDataFrame([(a.token, 0.1 + 0.2), (b.token, 0.3)], "token string, weight double")
    for w in (None, weights):
        got = {r.doc_id: list(r.embedding) for r in hashed_vectors(df, "doc_id", "text", 64, w).collect()}
        assert set(got) == {1, 2} and all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got.values())


def test_pairs_of_queries_and_rows_are_not_shuffled(spark):
    """Texts and postings are shuffled by row; what they are cut into or paired with stays there, but for what ranks."""
    from clausespark.operators import retrieval as R

    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 3} " * (i % 5 + 1)) for i in range(20_000)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "alpha gamma1"), (2, "beta2 gamma0 none"), (3, "alpha")], "item_id long, text string")
    made = R.inverted_index(docs, {"body": F.col("text")})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(made).count("hashpartitioning") == 1
    found = R.matches(R.write_index(docs, {"body": F.col("text")}), R.query_terms(asked, "item_id", "text"), {"body": 1.0})
    assert "hashpartitioning(query_id" not in plan(found)
    kept = R.with_fallback(found).collect()
    totals = Counter(r.query_id for r in kept)
    for k in (7, 1000):
        want = {q: sorted(((-r.score, r.doc_id) for r in kept if r.query_id == q))[:k] for q in totals}
        got = R.best_matches(found, k).collect()
        assert {q: sorted((-r.score, r.doc_id) for r in got if r.query_id == q) for q in totals} == want
        assert all(r.total == totals[r.query_id] for r in got)
