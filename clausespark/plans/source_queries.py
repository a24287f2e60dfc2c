"""Queries of file sources (A) and streams (S): given tables written in a format and read back, or read as a stream."""

from pyspark.sql import functions as F

from clausespark.operators.encoders import hashed_vectors
from clausespark.plans.data import table
from clausespark.plans.registry import query
from clausespark.plans.text_queries import _sql_plain
from clausespark.sources import readers as S
from clausespark.streaming import jobs as J


@query("a1_markdown_scan", "SELECT item_id, text FROM benchmark")
def a1(spark, d):
    path = S.scratch(spark, "markdown")
    table(spark, d, "benchmark").select("item_id", F.concat("text", F.lit("\n")).alias("value")).write.option("lineSep", "\n").partitionBy("item_id").text(path)
    got = S.read_markdown(spark, path)
    return got.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.regexp_replace("text", r"\n+$", "").alias("text"))


@query("a3_ocr_blocks", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)
SELECT doc_id, CAST(k // 5 + 1 AS INTEGER) AS page, CAST(k % 5 AS INTEGER) AS at, CASE WHEN k % 5 = 0 THEN 'title' ELSE 'text' END AS label, content FROM l""")
def a3(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "content"))
    block = F.struct(F.col("k").alias("k"), F.when(F.col("k") % 5 == 0, "title").otherwise("text").alias("block_label"), F.col("content").alias("block_content"), F.array(F.lit(0), F.col("k"), F.lit(100), F.col("k") + 1).alias("block_bbox"), (F.col("k") % 5).alias("block_order"), F.col("k").alias("global_block_id"), F.lit("dropped").alias("extra"))
    pages = lines.groupBy("doc_id", F.expr("k div 10").cast("int").alias("record"), F.expr("k div 5").alias("page")).agg(F.array_sort(F.collect_list(block)).alias("parsing_res_list"))
    one = F.struct("page", F.struct(F.lit(100).alias("width"), F.lit(200).alias("height"), "parsing_res_list").alias("prunedResult"))
    records = pages.groupBy("doc_id", "record").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["page"] - b["page"]).cast("int")).alias("layoutParsingResults"))
    path = S.scratch(spark, "ocr")
    records.select("doc_id", "record", F.struct("layoutParsingResults").alias("result")).write.json(path)
    return S.ocr_blocks(S.read_ocr(spark, path)).select("doc_id", "page", "at", "label", "content")


@query("a4_lexicon_csv", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'alias' WHEN 1 THEN 'confusable' ELSE 'synonym' END AS kind, p_name AS canonical, p_brand || ',' || p_type AS variants FROM part")
def a4(spark, d):
    k = F.col("p_partkey") % 4
    rows = table(spark, d, "part").select(F.when(k == 0, "别名").when(k == 1, "confusable").when(k == 2, "同义词").otherwise(" ").alias("﻿类型"), F.concat(F.lit(" "), "p_name").alias("标准词"), F.concat_ws(",", "p_brand", "p_type").alias("variants"), F.col("p_partkey").cast("string").alias("区别"))
    path = S.scratch(spark, "lexicon")
    rows.write.option("header", True).csv(path)
    return S.read_lexicon_csv(spark, path).select(F.col("distinguish").cast("long").alias("p_partkey"), "kind", "canonical", "variants")


@query("a7_rebuild_vectors")
def a7(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("spec"), F.col("lang").alias("title"), F.col("text").alias("content"))
    v = S.rebuild_vectors(c, lambda df, i, t: hashed_vectors(df, i, t, 64))
    return v.select("clause_id", "chunk_index", F.length("text").alias("chars"), F.size("embedding").alias("dims"))


def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder = S.scratch(spark, f"in-{name}")
    spark.read.parquet(path).write.parquet(folder)  # a stream reads a folder; the given table may be one file
    return spark.readStream.schema(schema).parquet(folder)


@query("s1_task_lifecycle", """WITH t AS (SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY 1), m AS (SELECT max(ts) AS m FROM events)
SELECT task_id, CASE status WHEN 'view' THEN 'review_needed' WHEN 'error' THEN 'error' ELSE 'done' END AS status, CASE status WHEN 'view' THEN 'drop_files' ELSE 'drop_row' END AS outcome FROM t, m WHERE status IN ('view', 'error', 'click') AND ts + CASE status WHEN 'view' THEN INTERVAL 1 DAY ELSE INTERVAL 30 MINUTE END < m - INTERVAL 1 HOUR""")
def s1(spark, d):
    e = F.col("event_type")
    status = F.when(e == "view", "review_needed").when(e == "error", "error").when(e == "click", "done").otherwise("processing")
    ev = _stream(spark, d, "events").select(F.col("user_id").alias("task_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    with J.rocksdb_state(spark):
        return J.run_to_table(J.task_lifecycle(ev), "append").select("task_id", "status", "outcome")


def _changes(spark, d, versions):
    """A stream of changes to documents: all of them, then edits of a third and deletions of a fifth.

    A version is as many files as a batch takes, so that all cores read it; later versions are in later files.
    """
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("clause_id"), "text")
    first = docs.withColumns({"version": F.lit(0), "deleted": F.lit(False)})
    edits = docs.where("clause_id % 3 = 0").select("clause_id", F.concat(F.lit("edited "), F.coalesce("text", F.lit(""))).alias("text"), F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    gone = docs.where("clause_id % 5 = 0").select("clause_id", F.lit(None).cast("string").alias("text"), F.lit(2).alias("version"), F.lit(True).alias("deleted"))
    folder, files = S.scratch(spark, "changes"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i, part in enumerate([first, edits, gone][:versions]):
        part.repartition(files).write.parquet(f"{folder}/v={i}")
    schema = "clause_id bigint, text string, version int, deleted boolean"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(folder)


#: Tables that the stream of changes has written, by session and folder.
_UPKEPT: dict = {}


def _upkept(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _UPKEPT:
        path = S.scratch(spark, "index")
        encoder = lambda df, i, t: hashed_vectors(df, i, t, 64)
        J.upkeep_index(_changes(spark, d, 3), f"{path}/data", f"{path}/checkpoint", encoder).awaitTermination()
        _UPKEPT[key] = f"{path}/data"
    return _UPKEPT[key]


@query("s2_index_upkeep", r"SELECT t AS token, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN 'edited ' ELSE '' END || text), '[\p{L}\p{N}]+')) AS t FROM documents WHERE doc_id % 5 <> 0) GROUP BY 1")
def s2(spark, d):
    return J.current_rows(spark, _upkept(spark, d), "postings").groupBy("token").agg(F.sum("tf").alias("tf"))


@query("s2_chunk_upkeep", f"""WITH b AS (SELECT doc_id, {_sql_plain("CASE WHEN doc_id % 3 = 0 THEN 'edited ' ELSE '' END || text")} AS body FROM documents WHERE doc_id % 5 <> 0) SELECT doc_id AS clause_id, body AS first FROM b WHERE length(body) BETWEEN 1 AND 512""")
def s2b(spark, d):
    """Chunks of the clauses that are one chunk after all changes, each with its vector."""
    c = J.current_rows(spark, _upkept(spark, d), "chunks")
    whole = c.groupBy("clause_id").agg(F.count("*").alias("n"), F.min("chunk").alias("first"), F.count("embedding").alias("vectors"))
    return whole.where("n = 1 AND vectors <= 1").select("clause_id", "first")


@query("s3_pending_counters", "SELECT 'dim' || (4 + o_orderkey % 3) AS dimension, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def s3(spark, d):
    rows = _stream(spark, d, "orders").select(F.concat(F.lit("dim"), (F.col("o_orderkey") % 3 + 4).cast("string")).alias("dimension"), F.col("o_orderstatus").alias("status"))
    return J.run_to_table(J.pending_counters(rows), "complete")
