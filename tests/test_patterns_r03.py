"""Keyword rules by words: results as by searching each text, and work that follows the words, not texts times patterns."""

from clausespark.operators import patterns as P


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_many_patterns_are_found_and_counted_as_in_each_text(spark):
    texts = [(1, "the abcdefg thethe aXa\naaaa"), (1, "the abcdefg thethe aXa\naaaa"), (2, None), (3, ""), (None, "  two  spaces the"), (4, "日本語の文章日本語\nthe 語")]
    words = ["the", "thethe", "abcdefg", "cdefg", "aa", "a", "  ", " ", "", "日本語", "a\na", "spaces the", "two  sp", "none", "x" * 40, None] + [f"rule{i}" for i in range(80)]
    df = spark.createDataFrame(texts, "id long, text string")
    p = spark.createDataFrame([(w,) for w in words], "pattern string")
    want = sorted(((i, w, t.count(w)) for i, t in texts for w in set(words) if t and w and w in t), key=repr)
    for few in (True, False):
        asked = p.where("pattern not like 'rule%'") if few else p
        assert rows_of(P.counted(df, "id", "text", asked), "id", "pattern", "found") == want
        assert rows_of(P.containing(df, "id", "text", asked), "id", "pattern") == [x[:2] for x in want]


def test_a_few_patterns_need_no_shuffle_of_texts(spark):
    """Before, all pieces of all texts were made and shuffled for a handful of rules."""
    df = spark.range(100).selectExpr("id", "concat('the text ', id) AS text")
    found = P.containing(df, "id", "text", spark.createDataFrame([("the",), ("ext 7",)], "pattern string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 111 and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
