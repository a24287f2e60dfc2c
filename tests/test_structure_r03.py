"""The structure step judges its lines once, whatever is made of them."""

from clausespark.functions import text as T
from clausespark.operators import structure as S


def test_lines_are_judged_once(spark, monkeypatch):
    """Before, the regular expressions of headings ran two to four times for one table of clauses."""
    lines = spark.createDataFrame([(1, 0, "# 1 总则"), (1, 1, "1.0.1 正文内容。"), (1, 2, "更多")], "doc_id long, line int, text string")
    times, judge = [], S.candidates
    monkeypatch.setattr(S, "candidates", lambda *a, **k: times.append(1) or judge(*a, **k))
    clauses = S.clause_table(lines)
    plan = S.survey(clauses)._jdf.queryExecution().optimizedPlan().toString()
    assert len(times) == 1 and "附录" not in plan and clauses.count() == 1
    S.head_blocks(lines)
    assert len(times) == 2


def test_strip(spark):
    odd = ["", " ", "\t\n a b 　 ", "\x0b\f\rx", "日本 　", " x ", None, " ﻿ "]
    want = [None if t is None else t.strip(" \t\n\x0b\f\r 　") for t in odd]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    assert [r.s for r in df.orderBy("i").select(T.strip(df.t).alias("s")).collect()] == want
