"""Snapshots, streams, patterns and packing on small inputs."""

import pytest
from pyspark.sql import functions as F

from clausespark.operators import context, lexicon, patterns, rules
from clausespark.sources import snapshots
from clausespark.streaming import jobs

LEX = "id long, kind string, canonical string, variants string, distinguish string, is_active int"


def test_an_interrupted_write_leaves_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "table")
    assert snapshots.current(spark, path) is None
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    snapshots.publish(one, path)
    reader = snapshots.published(spark, path)
    broken = one.withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        snapshots.publish(broken, path)
    assert sorted(map(tuple, snapshots.published(spark, path).collect())) == [(1, "a"), (2, "b")]
    new = snapshots.replace_keys(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), spark.createDataFrame([(1,), (2,)], "id long"), "id")
    assert sorted(map(tuple, new.collect())) == [(2, "c"), (3, "d")]
    assert sorted(map(tuple, reader.collect())) == [(1, "a"), (2, "b")]  # a reader that began before goes on
    snapshots.publish(one, path, format="json")
    assert snapshots.published(spark, path, "json", "id long, x string").count() == 2


def test_timers_and_late_events(spark, tmp_path):
    rows = [
        [(1, "review_needed", "2024-01-01 00:00:00"), (2, "done", "2024-01-01 00:10:00"), (3, "processing", "2024-01-01 00:20:00")],
        [(4, "processing", "2024-01-01 10:00:00"), (2, "error", "2024-01-01 00:05:00"), (3, "error", "2024-01-01 09:50:00")],
        [(1, "done", "2024-01-01 01:00:00"), (4, "processing", "2024-01-02 12:00:00")],
    ]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "task_id long, status string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/v={i}")
    stream = spark.readStream.schema("task_id long, status string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    with jobs.rocksdb_state(spark):
        got = sorted((r.task_id, r.status, r.outcome) for r in jobs.run_to_table(jobs.task_lifecycle(stream), "append").collect())
    # the late event of task 1 is older than the watermark, so its review runs out after a day
    assert got == [(1, "review_needed", "drop_files"), (2, "done", "drop_row"), (3, "error", "drop_row")]


def test_upkeep_of_changed_and_deleted_clauses(spark, tmp_path):
    batches = [[(1, 0, "alpha beta.", False), (2, 0, "gamma", False), (3, 0, "delta", False)], [(1, 1, "alpha old", False), (1, 2, "omega", False), (2, 1, None, True)]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, "clause_id long, version int, text string, deleted boolean").coalesce(1).write.parquet(f"{tmp_path}/in/v={i}")
    stream = lambda: spark.readStream.schema("clause_id long, version int, text string, deleted boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    from clausespark.operators.encoders import hashed_vectors

    encoder = lambda df, i, t: hashed_vectors(df, i, t, 8)

    def rows():
        chunks = sorted((r.clause_id, r.chunk_index, r.chunk, len(r.embedding)) for r in jobs.current_rows(spark, f"{tmp_path}/index", "chunks").collect())
        tokens = sorted((r.clause_id, r.token, r.tf) for r in jobs.current_rows(spark, f"{tmp_path}/index", "postings").collect())
        return chunks, tokens

    jobs.upkeep_index(stream(), f"{tmp_path}/index", f"{tmp_path}/checkpoint", encoder).awaitTermination()
    want = [(1, 0, "omega", 8), (3, 0, "delta", 8)], [(1, "omega", 1), (3, "delta", 1)]
    assert rows() == want
    # the same batches again, as after a lost checkpoint, change nothing
    jobs.upkeep_index(stream(), f"{tmp_path}/index", f"{tmp_path}/checkpoint-2", encoder).awaitTermination()
    assert rows() == want


def test_patterns(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "x混凝土y"), (3, ""), (4, None), (5, "aé😀b")], "id long, content string")
    asked = ["abc", "ab", "c", "混凝土", "凝", "zzz", "", "abcabcabc", "😀b", "bca"]
    got = patterns.containing(texts, "id", "content", spark.createDataFrame([(p,) for p in asked], "pattern string"))
    want = sorted((i, p) for i, t in [(1, "abcabc"), (2, "x混凝土y"), (5, "aé😀b")] for p in asked if p and p in t)
    assert sorted((r.id, r.pattern) for r in got.collect()) == want
    known = {"abc+d": "abc", "ab*c": "a", "x.yz{2}w": "x", "a*?bcd": "bcd", "a|b": "", "(ab)": "", r"\d+": "", "钢筋.*混凝土": "混凝土", "a+?bc": "bc", "": ""}
    got = spark.createDataFrame([(k,) for k in known], "p string").select("p", patterns.plain_piece(F.col("p")).alias("x")).collect()
    for r in got:
        assert len(r.x) == len(known[r.p]) and r.x in r.p, (r.p, r.x)


def test_regex_rules(spark):
    rule = "id long, dimension string, pattern string, match_type string, priority int, threshold double, label string, is_active int"
    rows = [(1, "d", "ab+c", "regex", 0, 0.1, "x", 1), (2, "d", "(?P<n>b+)", "regex", 0, 0.1, "x", 1), (3, "d", "(", "regex", 0, 0.1, "x", 1), (4, "d", "zz+", "regex", 0, 0.1, "x", 1), (5, "d", "a|c", "regex", 1, 0.1, "x", 1)]
    c = spark.createDataFrame([(1, "xxabbcxx"), (2, "nothing"), (3, None)], "id long, content string")
    got = {(r.id, r.rule_id): round(r.score, 6) for r in rules.scores(c, spark.createDataFrame(rows, rule).withColumnRenamed("id", "rule_id")).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (1, 5): 0.55}


def test_expansion_by_a_lexicon(spark):
    rows = [(1, "alias", "混凝土", "砼,混泥土", "", 1), (2, "synonym", "坍落度", "塌落度", "", 1), (3, "alias", "混凝土结构", "砼结构", "", 1), (4, "alias", "a.b", "c\\E", "", 1)]
    groups = spark.createDataFrame(rows, LEX)
    asked = spark.createDataFrame([(1, "砼强度等级"), (2, "混凝土结构施工"), (3, "砼"), (4, "xa.by"), (5, "c\\E"), (6, " "), (7, None), (8, "axb")], "query_id long, text string")
    got = {r.query_id: r.expression for r in lexicon.match_expressions(asked, "text", groups).collect()}
    assert got == {
        1: '("混凝土" OR "砼" OR "混泥土") AND "强度" AND "度等" AND "等级"', 2: '("混凝土结构" OR "砼结构") AND "施工"', 3: '("混凝土" OR "砼" OR "混泥土")',
        4: '"x" AND ("a.b" OR "c\\E") AND "y"', 5: '("a.b" OR "c\\E")', 6: "", 7: "", 8: '"axb"',
    }
    assert " OR " in {r.query_id: r.expression for r in lexicon.match_expressions(asked, "text", groups, "OR").collect()}[4].split(")")[1]


def test_replacements_that_bring_about_others(spark):
    rows = spark.createDataFrame([(1, "alias", "bc", "xyz", "", 1), (2, "alias", "Q", "ab,abc", "", 1), (3, "alias", "w", "q1", "", 1)], LEX)
    docs = spark.createDataFrame([(1, "axyz"), (2, "plain"), (3, None), (4, "abxyz q1")], "id long, t string")
    want = {1: "Qc", 2: "plain", 3: "", 4: "Qbc w"}
    for fold in (1000, 0):
        assert {r.id: r.normalized for r in lexicon.normalize_text(docs, "id", "t", rows, fold=fold).collect()} == want, fold


def test_packing_in_rounds(spark):
    import random

    rng = random.Random(2)
    items = [(k, i, rng.randint(0, 3), rng.choice([0, 1, 5, 40, 60, 90])) for k in (1, 2, None) for i in range(60)] + [(3, 0, 0, 51), (4, 0, 0, None)]
    df = spark.createDataFrame(items, "q long, id long, o int, cost int")
    want = {}
    for k in {x[0] for x in items}:
        used, picked, n = 0, [], 0
        for _, i, _, c in sorted((x for x in items if x[0] == k), key=lambda x: (x[2], x[1])):
            n += 1
            if c is not None and c <= 50 and used + c <= 100:
                used += c
                picked.append(str(i))
        want[k] = (",".join(picked), used, n - len(picked))
    for fold in (10_000, 3):
        got = {r.q: (r.picked, r.used, r.dropped) for r in context.pack_budget(df, "q", ["o"], "cost", 100, fold=fold).collect()}
        assert got == want, fold
