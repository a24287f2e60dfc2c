import hashlib

from clausespark.llm.infill import fill_in_middle, op13_fill_in_middle, restore


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{doc_id if doc_id is not None else ''}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return len(t), "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_forms_cuts_and_outputs(spark):
    odd = [None, "", "a", "<P>", "x<M>y", "<", "<<P", "é" * 7, "a😀b\x00c", "<S" * 50, "word " * 100_000, " \n\t"]
    rows = [(i, t) for i, t in enumerate(odd * 12)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, form string, n int")
    found = sorted(map(tuple, fill_in_middle(docs).drop("output_sha256").collect()), key=str)
    assert found == sorted([(i, *brute(i, t)) for i, t in rows], key=str)
    back = restore(fill_in_middle(docs)).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(200)] + [(1000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, op13_fill_in_middle(spark, str(tmp_path)).collect())) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert restore(fill_in_middle(empty)).count() == 0
