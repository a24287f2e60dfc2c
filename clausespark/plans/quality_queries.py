"""Queries of data quality, lifecycle and logs (H) and of sources and sinks (A)."""

from pyspark.sql import functions as F

from clausespark.functions.text import tokenize
from clausespark.operators import quality as Q
from clausespark.plans.data import table
from clausespark.plans.registry import query
from clausespark.sources.snapshots import publish, replace_keys
from clausespark.tables import new_path

TREE = "tree AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN doc_id + 10000000 WHEN doc_id % 3 = 0 THEN doc_id // 3 END AS parent FROM documents)"


def tree(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(k.alias("id"), F.when(k % 50 == 0, k + 10_000_000).when(k % 3 == 0, F.expr("doc_id div 3")).alias("parent"))


def _ids(spark, d, name, col):
    return table(spark, d, name).select(F.col(col).alias("id"))


@query("h1_orphan_parents", f"WITH {TREE} SELECT id, parent FROM tree WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM tree)")
def h1(spark, d):
    return Q.orphan_parents(tree(spark, d))


@query("h2_empty_content", "SELECT doc_id AS id FROM documents WHERE source = 'src3' OR text IS NULL OR trim(text) = ''")
def h2(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.when(F.col("source") == "src3", " \n\u3000\t").otherwise(F.col("text")))
    return Q.empty_content(docs, "doc_id", "text")


def _labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.when(F.col("lang") != "fr", 1).otherwise(0).alias("ai_classified"), F.lit(0).alias("needs_review"), F.col("quality").cast("string").alias("dim4"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("dim5"))


LABELLED = "lab AS (SELECT doc_id AS id, CASE WHEN lang <> 'fr' THEN 1 ELSE 0 END AS ai_classified, 0 AS needs_review, CAST(quality AS VARCHAR) AS dim4, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS dim5 FROM documents LEFT JOIN labels USING (doc_id)), bad AS (SELECT id FROM lab WHERE ai_classified = 1 AND coalesce(dim4, '') = '' AND coalesce(dim5, '') = '')"


@query("h3_bad_classification", f"WITH {LABELLED} SELECT id FROM bad")
def h3(spark, d):
    return Q.bad_classification(_labelled(spark, d), ["dim4", "dim5"])


@query("h7_fix_labels", f"WITH {LABELLED} SELECT lab.id, CASE WHEN bad.id IS NULL THEN ai_classified ELSE 0 END AS ai_classified, CASE WHEN bad.id IS NULL THEN 0 ELSE 1 END AS needs_review FROM lab LEFT JOIN bad USING (id)")
def h7b(spark, d):
    return Q.fix_labels(_labelled(spark, d), ["dim4", "dim5"]).select("id", "ai_classified", "needs_review")


@query("h7_fix_vectors", "SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'kept' ELSE 'added' END AS origin, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS added, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS removed FROM documents")
def h7c(spark, d):
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("kept").alias("origin"))
    fixed, counts = Q.fix_rows(have, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("added").alias("origin")))
    return fixed.join(F.broadcast(counts))  # one row


@query("h6_flag", """SELECT 'red' AS flag, 'bad_classification,orphan_parent' AS keys UNION ALL SELECT 'yellow', 'empty_content'""")
def h6b(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.when(F.col("source") == "src3", " ").otherwise(F.col("text")))
    report = Q.health_report({"orphan_parent": (Q.orphan_parents(tree(spark, d)), True), "empty_content": (Q.empty_content(docs, "doc_id", "text"), False), "bad_classification": (Q.bad_classification(_labelled(spark, d), ["dim4", "dim5"]), True), "no_id": (docs.where("doc_id is null"), True)})
    return Q.health_flag(report).select("flag", F.array_join("keys", ",").alias("keys"))


@query("h6_snapshot", """WITH r AS (SELECT count(*) AS n FROM documents WHERE source = 'src3' OR text IS NULL OR trim(text) = '') SELECT TIMESTAMP '2024-01-01' AS at, '[]' AS result UNION ALL SELECT TIMESTAMP '2024-02-01', '[{"key":"empty_content","n":' || n || ',"severity":"error","fixable":false}]' FROM r""")
def h6c(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.when(F.col("source") == "src3", " ").otherwise(F.col("text")))
    history = table(spark, d, "documents").agg(F.min(F.lit("2024-01-01").cast("timestamp_ntz")).alias("at"), F.lit("[]").alias("result"))
    return Q.snapshot(Q.health_report({"empty_content": (Q.empty_content(docs, "doc_id", "text"), False)}), history, "2024-02-01")


@query("h4_vector_differences", "SELECT doc_id AS id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'orphan' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def h4(spark, d):
    return Q.id_differences(_ids(spark, d, "documents", "doc_id"), _ids(spark, d, "embeddings", "vec_id"))


@query("h5_index_mismatch", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[\p{L}\p{N}]') OR doc_id NOT IN (SELECT doc_id FROM labels)")
def h5(spark, d):
    docs = table(spark, d, "documents")
    indexed = docs.where(F.size(tokenize("text")) > 0).join(table(spark, d, "labels"), "doc_id", "left_semi")
    return docs.join(indexed, "doc_id", "left_anti").select("doc_id")


@query("h6_health_report", f"""WITH {TREE}, c AS (SELECT 'orphan_parent' AS key, (SELECT count(*) FROM tree WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM tree)) AS n, true AS fixable UNION ALL
SELECT 'empty_content', (SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = ''), false UNION ALL SELECT 'vector_missing', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), true)
SELECT key, n, CASE WHEN n = 0 THEN 'ok' WHEN fixable THEN 'warn' ELSE 'error' END AS severity, fixable FROM c""")
def h6(spark, d):
    docs = table(spark, d, "documents")
    missing = Q.id_differences(_ids(spark, d, "documents", "doc_id"), _ids(spark, d, "embeddings", "vec_id")).where("side = 'missing'")
    return Q.health_report({"orphan_parent": (Q.orphan_parents(tree(spark, d)), True), "empty_content": (docs.where("text is null or trim(text) = ''"), False), "vector_missing": (missing, True)})


@query("h7_fix_parents", f"WITH {TREE} SELECT id, CASE WHEN parent IN (SELECT id FROM tree) THEN parent END AS parent FROM tree")
def h7(spark, d):
    t = tree(spark, d)
    bad = Q.orphan_parents(t).select("id", F.lit(True).alias("bad"))
    return t.join(bad, "id", "left").select("id", F.when(F.col("bad"), None).otherwise(F.col("parent")).alias("parent"))


def _logs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.when(F.col("value") > 10, "WARN").otherwise("INFO").alias("level"), F.col("event_type").alias("action"), F.col("props").alias("detail"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.col("ts").alias("created_at"))


@query("h8_filter_logs", "SELECT event_id AS id FROM events WHERE event_type = 'view' AND value > 10 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' AND (contains(event_type, '7') OR contains(props, '7') OR contains('u' || user_id, '7'))")
def h8(spark, d):
    return Q.filter_logs(_logs(spark, d), "view", ("WARN",), "", "2024-01-05", "2024-01-20", "7").select("id")


@query("h9_retention", """WITH n AS (SELECT event_type AS category, count(*) FILTER (ts >= TIMESTAMP '2024-01-11') AS late, count(*) AS whole FROM events GROUP BY 1)
SELECT 'days' AS how, category, late AS kept FROM n WHERE late > 0 UNION ALL SELECT 'category', category, whole FROM n WHERE category <> 'view'""")
def h9(spark, d):
    out = None
    for how, args in (("days", {"as_of": "2024-02-10", "days": 30}), ("category", {"category": "view"}), ("all", {})):
        kept, _ = Q.clean_logs(_logs(spark, d), **args)
        one = kept.groupBy("category").agg(F.count("*").alias("kept")).select(F.lit(how).alias("how"), "category", "kept")
        out = one if out is None else out.union(one)
    return out


@query("h9_removed", "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-11') AS removed FROM events")
def h9b(spark, d):
    return Q.clean_logs(_logs(spark, d), "2024-02-10", 30)[1]


@query("h10_task_disposition", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'keep' WHEN event_type = 'view' AND date_diff('second', ts, TIMESTAMP '2024-02-01') > 86400 THEN 'drop_files' WHEN event_type IN ('error', 'click') AND date_diff('second', ts, TIMESTAMP '2024-02-01') > 1800 THEN 'drop_row' ELSE 'keep' END AS disposition FROM events""")
def h10(spark, d):
    e = F.col("event_type")
    status = F.when(e == "view", "review_needed").when(e == "error", "error").when(e == "click", "done").otherwise("processing")
    # whole seconds of both times: a part of a second counts as the second it lies in
    age = F.when(F.col("event_id") % 11 != 0, F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", Q.task_disposition(status, age).alias("disposition"))


@query("h11_heal_tasks", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'error' ELSE event_type END AS status, CASE WHEN event_type IN ('view', 'click') THEN TIMESTAMP '2024-02-01' ELSE ts END AS updated_at FROM events")
def h11(spark, d):
    t = F.col("event_type")
    tasks = table(spark, d, "events").select("event_id", F.when(t == "view", "uploading").when(t == "click", "processing").otherwise(t).alias("status"), F.col("ts").alias("updated_at"))
    return Q.heal_tasks(tasks, "2024-02-01")


@query("h12_spec_list", """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT row_number() OVER (ORDER BY c.c_acctbal DESC, c.c_custkey) AS place, c.c_custkey AS id, c.c_name AS code, coalesce(n, 0) AS clause_count, r.c_name AS replace_by_code, r.c_mktsegment AS replace_by_title
FROM customer c LEFT JOIN n ON o_custkey = c.c_custkey LEFT JOIN customer r ON r.c_custkey = CASE WHEN c.c_custkey % 3 = 0 THEN c.c_custkey + 1 END""")
def h12(spark, d):
    k = F.col("c_custkey")
    specs = table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("code"), F.col("c_mktsegment").alias("title"), F.col("c_acctbal").alias("created_at"), F.when(k % 3 == 0, k + 1).alias("replace_by"))
    return Q.spec_list(specs, table(spark, d, "orders").select(F.col("o_custkey").alias("spec_id")))


SPECS = "specs AS (SELECT s_suppkey AS id, s_name AS code, CASE s_suppkey % 3 WHEN 0 THEN '废止' WHEN 1 THEN '现行' ELSE '修订中' END AS status, (SELECT any_value(x.s_name) FROM supplier x WHERE x.s_suppkey = s.s_suppkey + 4) AS rc FROM supplier s)"


def specs(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    named = s.select((k - 4).alias("id"), F.col("s_name").alias("replaced_by_code"))
    base = s.select(k.alias("id"), F.col("s_name").alias("code"), F.when(k % 3 == 0, "废止").when(k % 3 == 1, "现行").otherwise("修订中").alias("status"))
    return base.join(named, "id", "left")


LINKED = f"{SPECS}, j AS (SELECT a.id, min(b.id) AS other FROM specs a LEFT JOIN specs b ON a.rc = b.code AND a.id <> b.id GROUP BY 1), t AS (SELECT other AS id, min(j.id) AS by_id FROM j JOIN specs USING (id) WHERE status = '现行' AND other IS NOT NULL GROUP BY 1), linked AS (SELECT s.id, CASE WHEN by_id IS NOT NULL THEN '废止' ELSE status END AS status, coalesce(by_id, CASE WHEN status IN ('废止', '修订中') THEN other END) AS successor FROM specs s JOIN j USING (id) LEFT JOIN t USING (id))"


@query("h13_replacement_links", f"WITH {LINKED} SELECT id, status, successor FROM linked")
def h13(spark, d):
    return Q.link_replacements(specs(spark, d))


@query("h14_parameters", "SELECT 'k' || p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN least(greatest(p_size::DOUBLE, 5), 40) ELSE 10.0 END AS value FROM part")
def h14(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    key = F.concat(F.lit("k"), k.cast("string")).alias("key")
    raw = F.when(k % 4 == 0, F.col("p_size").cast("string")).otherwise("bad")
    return Q.resolve_parameters(p.select(key, F.lit(10.0).alias("value"), F.lit(5.0).alias("low"), F.lit(40.0).alias("high")), p.where(k % 2 == 0).select(key, raw.alias("raw")))


@query("h15_rederive", r"SELECT doc_id AS clause_id, array_to_string(regexp_extract_all(lower(CASE WHEN doc_id % 10 = 0 THEN 'edited ' || text ELSE text END), '[\p{L}\p{N}]+'), ' ') AS search_text FROM documents")
def h15(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("clause_id"), "text")
    changed = docs.where("clause_id % 10 = 0").withColumn("text", F.concat(F.lit("edited "), "text"))
    derive = lambda df: df.select("clause_id", F.array_join(tokenize("text"), " ").alias("search_text"))
    return Q.replace_chunks(derive(docs), derive(changed), changed.select("clause_id"))


@query("h16_clause_listing", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS place FROM documents WHERE source = 'src3'")
def h16(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "documents").where("source = 'src3'").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("place"))


@query("a2_content_hash", "SELECT sha256(html) AS file_hash, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1")
def a2(spark, d):
    return table(spark, d, "pages").groupBy(F.sha2("html", 256).alias("file_hash")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query("a2_known_files", "SELECT item_id, sha256(text || chr(10)) AS file_hash, CASE WHEN item_id % 2 = 0 THEN item_id + 100 END AS spec_id FROM benchmark")
def a2b(spark, d):
    """Each item written as a file of raw bytes and read as binary; every second one is known by the hash of its bytes."""
    from clausespark.sources.readers import known_files, read_binary

    items, path = table(spark, d, "benchmark"), new_path(spark, "files")
    items.select("item_id", F.col("text").alias("value")).write.option("lineSep", "\n").partitionBy("item_id").text(path)
    specs = items.where("item_id % 2 = 0").select((F.col("item_id") + 100).alias("id"), F.sha2(F.concat("text", F.lit("\n")), 256).alias("file_hash"))
    found = known_files(read_binary(spark, f"{path}/*/*.txt"), specs)
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "file_hash", "spec_id")


@query("a5_table_scan", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
def a5(spark, d):
    out = None
    for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("a6_vector_ids", "SELECT DISTINCT vec_id FROM embeddings")
def a6(spark, d):
    return table(spark, d, "embeddings").select("vec_id").distinct()


@query("a8_replace_chunks", "SELECT vec_id AS clause_id, label FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 20 = 0")
def a8(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("clause_id"), "label")
    path = new_path(spark, "chunks")
    publish(e, path)
    return replace_keys(spark, path, e.where("clause_id % 20 = 0").withColumn("label", F.col("label") + 100), e.where("clause_id % 10 = 0").select("clause_id"), "clause_id")


@query("a9_cascade_delete", f"WITH {LINKED} SELECT id, CASE WHEN successor % 5 = 0 THEN NULL ELSE successor END AS successor, (SELECT count(*) FROM lineitem WHERE l_suppkey = linked.id) AS clauses FROM linked WHERE id % 5 <> 0")
def a9(spark, d):
    s = Q.link_replacements(specs(spark, d))
    left, children = Q.cascade_delete(s, {"clauses": table(spark, d, "lineitem").select(F.col("l_suppkey").alias("spec_id"))}, s.where("id % 5 = 0").select("id"))
    n = children["clauses"].groupBy(F.col("spec_id").alias("id")).agg(F.count("*").alias("clauses"))
    return left.join(n, "id", "left").select("id", "successor", F.coalesce("clauses", F.lit(0)).alias("clauses"))


@query("a10_json_export", """SELECT p_partkey, '{"id":' || p_partkey || ',"pattern":"' || p_name || '","label":"' || p_type || '"}' AS line FROM part""")
def a10(spark, d):
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("pattern"), F.col("p_type").alias("label"))).alias("line"))


@query("a12_seed", """WITH r AS (SELECT 'dim' || p_size % 3 AS dimension, p_name AS pattern, min(p_brand) AS sub_field, 'keyword' AS match_type, CAST(count(*) AS INTEGER) AS priority, 0.6::DOUBLE AS threshold, 0 AS locked, 1 AS is_active FROM part GROUP BY ALL),
s AS (SELECT 'dim' || p_size % 3 AS dimension, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'seed ' || p_name END AS pattern, p_type AS sub_field, CASE WHEN p_size % 2 = 0 THEN 'exact' ELSE 'keyword' END AS match_type, p_size AS priority, 0.25::DOUBLE AS threshold FROM part)
SELECT * FROM r UNION ALL SELECT dimension, pattern, sub_field, match_type, priority, threshold, 1, 1 FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.dimension = s.dimension AND r.pattern = s.pattern) QUALIFY row_number() OVER (PARTITION BY dimension, pattern ORDER BY sub_field, match_type, priority, threshold) = 1""")
def a12(spark, d):
    p = table(spark, d, "part").withColumn("dimension", F.concat(F.lit("dim"), (F.col("p_size") % 3).cast("string")))
    zero = {"hit_count": F.lit(0), "confirmed": F.lit(0), "label": F.lit(None).cast("string"), "locked": F.lit(0), "is_active": F.lit(1), "match_type": F.lit("keyword"), "threshold": F.lit(0.6)}
    rules = p.groupBy("dimension", F.col("p_name").alias("pattern")).agg(F.min("p_brand").alias("sub_field"), F.count("*").cast("int").alias("priority")).withColumns(zero)
    pattern = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("seed "), "p_name"))
    seed = p.select("dimension", pattern.alias("pattern"), F.col("p_type").alias("sub_field"), F.when(F.col("p_size") % 2 == 0, "exact").otherwise("keyword").alias("match_type"), F.col("p_size").alias("priority"), F.lit(0.25).alias("threshold"))
    return Q.seed_rules(rules, seed).select("dimension", "pattern", "sub_field", "match_type", "priority", "threshold", "locked", "is_active")


@query("a13_audit", """SELECT 'job' AS category, 'INFO' AS level, 'cleanup' AS action, '{"rows":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' AS detail FROM events""")
def a13(spark, d):
    return Q.audit("cleanup", "INFO", table(spark, d, "events").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users")))


@query("a9_cascade", """WITH c AS (SELECT o_orderkey AS id, o_custkey AS spec_id FROM orders WHERE o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0), n AS (SELECT spec_id, count(*) AS n FROM c GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN (c_custkey + 1) % 5 <> 0 OR c_custkey + 1 NOT IN (SELECT c_custkey FROM customer) THEN c_custkey + 1 END AS successor, coalesce(n, 0) AS clause_count, (SELECT count(*) FROM lineitem JOIN c ON l_orderkey = c.id WHERE c.spec_id = c_custkey) AS vectors FROM customer LEFT JOIN n ON spec_id = c_custkey WHERE c_custkey % 5 <> 0""")
def a9b(spark, d):
    specs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1).alias("successor"), F.lit(-1).cast("long").alias("clause_count"))
    clauses = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("spec_id"))
    vectors = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clause_id"))
    left, kept, tables = Q.cascade(specs, clauses, {"vectors": vectors}, specs.where("id % 5 = 0").select("id"), clauses.where("id % 7 = 0").select("id"))
    n = tables["vectors"].join(kept.select(F.col("id").alias("clause_id"), "spec_id"), "clause_id").groupBy(F.col("spec_id").alias("id")).agg(F.count("*").alias("vectors"))
    return left.join(n, "id", "left").fillna(0, ["vectors"]).select("id", "successor", "clause_count", "vectors")


@query("a10_exports", """SELECT 'queue' AS kind, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","clause":' || o_custkey || ',"code":"' || c_name || '"}' AS line FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'report', '{"key":"orphan_parent","n":' || count(*) || ',"severity":"' || CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END || '","fixable":true}' FROM (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN doc_id + 10000000 WHEN doc_id % 3 = 0 THEN doc_id // 3 END AS parent FROM documents) WHERE parent IS NOT NULL AND parent NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'log', '{"id":' || event_id || ',"category":"' || event_type || '"}' FROM events WHERE event_type = 'error'""")
def a10b(spark, d):
    clauses = table(spark, d, "customer").select(F.col("c_custkey").alias("clause"), F.col("c_name").alias("code"))
    queue = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("clause")).join(clauses, "clause").select("id", "status", "clause", "code")
    report = Q.health_report({"orphan_parent": (Q.orphan_parents(tree(spark, d)), True)})
    logs = Q.filter_logs(_logs(spark, d), "error").select("id", "category")
    path, rows = new_path(spark, "exports"), Q.json_lines(queue, "queue").union(Q.json_lines(report, "report")).union(Q.json_lines(logs, "log"))
    rows.write.partitionBy("kind").text(path)
    return spark.read.text(path).select("kind", F.col("value").alias("line"))


@query("h15_rederive_whole", r"""SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'new 9 1' ELSE 'old' END AS search_text, CASE WHEN doc_id % 10 = 0 THEN array_to_string(regexp_extract_all(lower(source), '[\p{L}\p{N}]+'), ' ') ELSE 'old' END AS breadcrumb, CASE WHEN doc_id % 10 = 0 THEN source || ' ' || lang || ' [1] ' || source || ' new 9' ELSE 'old' END AS chunk FROM documents""")
def h15b(spark, d):
    docs = table(spark, d, "documents")
    old = lambda c: F.lit("old").alias(c)
    clauses = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("spec_code"), F.col("lang").alias("spec_title"), old("clause_no"), old("title"), F.col("text").alias("content"), F.col("source").alias("section_path"), old("search_text"), old("breadcrumb"))
    chunks = docs.select(F.col("doc_id").alias("clause_id"), F.lit(0).alias("chunk_index"), old("chunk"))
    edits = clauses.where("id % 10 = 0").select("id", F.lit("1").alias("clause_no"), F.lit("new").alias("title"), F.lit("<b>9</b>").alias("content"))
    got, pieces = Q.rederive(clauses, chunks, edits)
    return got.join(pieces.withColumnRenamed("clause_id", "id"), "id").select("id", "search_text", "breadcrumb", "chunk")
