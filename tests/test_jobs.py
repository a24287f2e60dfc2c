from pyspark.sql import functions as F

from clausespark.operators import context, lexicon, quality, retrieval, rules, structure

RULE = "id long, dimension string, pattern string, match_type string, priority int, threshold double, label string, is_active int"
LEX = "id long, kind string, canonical string, variants string, distinguish string, is_active int"


def test_rule_scores_and_ties(spark):
    c = spark.createDataFrame([(1, "one hit")], "id long, content string")
    r = lambda *rows: spark.createDataFrame(list(rows), RULE)
    assert rules.classify(c, r((1, "dim4", "hit", "keyword", 0, 0.45, None, 1))).count() == 0
    got = rules.classify(c, r((7, "dim4", "hit", "keyword", 0, 0.4, "late", 1), (3, "dim4", "one", "keyword", 0, 0.4, "early", 1))).first()
    assert (got.label, got.rule_id) == ("early", 3) and abs(got.score - 0.45) < 1e-9


def test_fusion(spark):
    s = "query_id long, doc_id long, rank int"
    a, b = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], s), spark.createDataFrame([(1, 2, 1), (1, 3, 2)], s)
    got = [(r.doc_id, r.tag) for r in retrieval.fuse(a, b).orderBy("rank").collect()]
    assert got == [(2, "hybrid"), (1, "keyword"), (3, "semantic")]


def test_lexicon(spark):
    rows = spark.createDataFrame([(1, "synonym", "a", "b", "", 1), (2, "alias", "c", "b", "", 1), (3, "confusable", "b", "z", "x", 1), (4, "alias", "x", "y", "", 1)], LEX)
    assert {r.id for r in lexicon.active_groups(rows).collect()} == {3, 4}
    found = lexicon.clusters(rows)
    assert {(r.id, r.cluster) for r in found.collect()} == {(1, 1), (2, 1)}
    done = lexicon.resolve_clusters(rows, lexicon.cluster_actions(rows, found), found)
    assert lexicon.conflicting_words(done).count() == 0 and done.count() == 3


def test_context(spark):
    items = spark.createDataFrame([(1, 1, 0, 40), (1, 2, 1, 60), (1, 3, 2, 30), (1, 4, 3, 20)], "q long, id long, o int, cost int")
    got = context.pack_budget(items, "q", ["o"], "cost", 100).first()
    assert (got.picked, got.used, got.dropped) == ("1,3,4", 90, 1)
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d"), (1, 5, "user", " ")], "conv_id long, turn long, role string, text string")
    assert [(r.question, r.answer) for r in context.turns(m).collect()] == [("b", "c")]
    k = spark.createDataFrame([(0,), (5,), (80,), (120,), (900,)], "n long").select(context.dynamic_k(F.col("n")).alias("k"))
    assert [r.k for r in k.collect()] == [0, 5, 10, 12, 15]


def test_structure(spark):
    md = "封面\n# 6 模板\n6.1 一般规定\n6.1.1 模板应当牢固。\n续行\n# 3 倒退\n6.1.1 重复引用\n# 7 钢筋\n7.1.1 钢筋应合格。\n# 条文说明\n7.1.1 说明文字很重要。"
    lines = structure.to_lines(spark.createDataFrame([(1, md)], "doc_id long, text string"))
    got = {r.no: r for r in structure.clause_table(lines).where("not is_non").collect()}
    assert got["6.1.1"].content.startswith("模板应当牢固。\n续行") and got["6.1.1"].path.startswith("6 模板 > 6.1")
    assert "3" not in got and got["7.1.1"].content.startswith("钢筋应合格。")
    assert structure.head_blocks(lines).first().content == "封面"


def test_blocks_and_nulls(spark):
    h = spark.createDataFrame([(1, 2, "1"), (1, 5, "2")], "doc_id long, line int, no string")
    b = spark.createDataFrame([(1, 0), (1, 2), (1, 9)], "doc_id long, start int")
    assert [r.no for r in structure.assign_blocks(h, b).orderBy("start").collect()] == [None, "1", "2"]
    p = spark.createDataFrame([(None, "d", "p", "l")], "clause_id long, dimension string, pattern string, label string")
    assert rules.insert_pending(p, p).count() == 0 and rules.insert_pending(p, p.limit(0)).count() == 1
    logs = spark.createDataFrame([("a", "INFO", "x", "y", "u")], "category string, level string, action string, detail string, username string").withColumn("created_at", F.expr("timestamp_ntz '2024-01-05 10:00:00'"))
    assert quality.filter_logs(logs, start="2024-01-05", end="2024-01-05").count() == 1 and quality.filter_logs(logs, start="nonsense").count() == 1


def test_query_terms_are_whole(spark):
    """Every token of a query asks, pairs of ideographs and the words behind the third too."""
    from clausespark.operators import retrieval as R

    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma"), (3, "混凝土 of it")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "alpha beta gamma delta"), (11, "混凝土"), (12, "of it")], "id long, text string")
    found = R.matches(R.write_index(docs, {"body": F.col("text")}), R.query_terms(asked, "id", "text"), {"body": 1.0})
    got = sorted((r.query_id, r.doc_id, r.matched, r.asked) for r in found.collect())
    assert got == [(10, 1, 4, 4), (10, 2, 3, 4), (11, 3, 1, 1), (12, 3, 2, 2)]
