"""An index row has all postings of its id, and searches make pairs where the row is."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from clausespark.functions.text import token_runs
from clausespark.operators import postings as P
from clausespark.operators import retrieval as R
from clausespark.plans import registry

registry.load()
TEXTS = ["Alpha beta alpha", "", None, "混凝土ab混凝 土 of 12 混", "ſtraße ﬀ ① Ⅳ a_b-c", "😀x alpha", "混凝土", "  alpha", "beta " * 50]


def test_postings_are_as_token_runs_has_them(spark):
    """Places, runs of ideographs, texts without tokens, null ids and rows that repeat an id, of which len counts all."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "beta gamma"), (None, "alpha"), (None, "delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, lens = Counter(), Counter()
    for r in docs.select("doc_id", token_runs("text").alias("runs")).collect():
        at = 0
        for run in r.runs:
            for t in run:
                want[r.doc_id, t, at] += 1
                lens[r.doc_id] += 1
                at += 1
            at += 1
    made = R.inverted_index(docs, {"body": F.col("text")})
    got, n = Counter(), {}
    for r in made.collect():
        assert r.field == "body" and r.tf == len(r.positions) and r.positions == sorted(r.positions)
        got.update((r.doc_id, r.token, p) for p in r.positions)
        n[r.doc_id] = r.len
    assert got == want and n == dict(lens)
    # nothing is collected posting by posting
    assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()


def test_searches_shuffle_no_postings(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 3} 混凝土{'混凝' * (i % 2)} " * (i % 5 + 1)) for i in range(5_000)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha gamma1 alpha"), (2, "beta2 gamma0 none"), (3, "混凝土"), (4, "土混"), (5, "nothing")], "item_id long, text string")
    index, terms = R.write_index(docs, {"body": F.col("text")}), R.query_terms(asked, "item_id", "text")
    found = R.matches(index, terms, {"body": 1.0})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    n = Counter(r.query_id for r in found.collect())
    has = lambda *ts: sum(any(t in f"alpha beta{i % 7} gamma{i % 3}".split() for t in ts) for i in range(5_000))
    assert n == {1: 5_000, 2: has("beta2", "gamma0"), 3: 5_000, 4: 2_500}
    kept = R.with_fallback(found).collect()
    for k in (3, 700):
        want = {q: sorted((-r.score, r.doc_id) for r in kept if r.query_id == q)[:k] for q in n}
        got = R.ranked(R.search(index, terms, {"body": 1.0}, k), [F.desc("score"), "doc_id"], k).collect()
        assert {q: sorted((-r.score, r.doc_id) for r in got if r.query_id == q) for q in n} == want
        assert all(r.total == sum(x.query_id == r.query_id for x in kept) for r in got)


def test_tiles_of_queries_and_cells(spark, monkeypatch):
    """However few queries and hits are taken at once, the pairs are the same."""
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 5} c") for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"a{i % 4} c b{i % 7}") for i in range(40)], "item_id long, text string")
    index, terms = R.write_index(docs, {"body": F.col("text")}), R.query_terms(asked, "item_id", "text")
    rows = lambda: sorted(map(tuple, R.matches(index, terms, {"body": 1.0}).collect()))
    want = rows()
    monkeypatch.setattr(R, "QUERIES", 7)
    assert rows() == want and len(want) == 40 * 200
    batch = index.rows.toArrow().to_batches()[0]
    own = P.asked_of([(i, [(f"a{i % 4}",), ("c",), (f"b{i % 7}",)]) for i in range(40)])
    hits = P.Hits(batch, own, P.np.ones(1))
    count = lambda: sum(len(q) for q, *_ in hits.pairs(own, None))
    want = count()
    monkeypatch.setattr(P, "CELLS", 1)
    monkeypatch.setattr(P, "HITS", 1)
    assert count() == want
    assert R.matches(index, terms.limit(0), {"body": 1.0}).count() == 0


def test_phrases_against_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(["ab abcab. zz", "abc", "cabab zz q", "", "q"])], "doc_id long, text string, source string, lang string")
    asked = spark.createDataFrame([(1, "ab x zz"), (2, "abc"), (3, "q cab"), (4, "12")], "item_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    asked.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for q in ("e5_phrases", "e5_all_terms", "e7_body_only", "e9_field_tiers", "e4_written_index"):
        cur = con.execute(registry.oracle_sql()[q])
        names = [x[0] for x in cur.description]
        got = [tuple(r[c] for c in names) for r in registry.queries()[q](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(cur.fetchall()), q
