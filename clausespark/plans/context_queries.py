"""Queries of context assembly (G): conversations are messages, events and documents the candidates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausespark.functions.text import estimate_tokens
from clausespark.operators import context as C
from clausespark.plans.data import table
from clausespark.plans.registry import query
from clausespark.plans.retrieval_queries import FUSED, _fused as fused


def _items(spark, d):
    """Documents as candidates of their source, scored by their id's last digits."""
    score = (F.col("doc_id") * 37 % 100) / 100
    return table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), score.alias("score"), F.col("text").alias("content"), estimate_tokens("text").alias("tokens"))


ITEMS = "i AS (SELECT source, doc_id AS id, (doc_id * 37 % 100) / 100 AS score, text AS content, CAST(ceil(length(text) / 2.0) AS INTEGER) AS tokens FROM documents)"


@query("g1_metadata_filter", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 < 2 OR o_orderstatus IN ('O')")
def g1(spark, d):
    k = F.col("o_orderkey") % 7
    o = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, None).when(k == 1, "").otherwise(F.col("o_orderstatus")).alias("status"))
    return o.where(C.in_force(F.col("status"), ["O"]))


@query("g2_score_filter", f"WITH {ITEMS} SELECT id FROM i WHERE score >= 0.5")
def g2(spark, d):
    return _items(spark, d).where("score >= 0.5").select("id")


@query("g3_dynamic_k", f"WITH {ITEMS}, r AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM i) SELECT source, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE WHEN n < 10 THEN n ELSE least(greatest(ceil(n * 0.1), 10), 15) END")
def g3(spark, d):
    return C.select_dynamic(_items(spark, d), "source", [F.desc("score"), "id"]).select("source", "id", "rank")


@query("g4_tiers", f"WITH {ITEMS} SELECT id, CASE WHEN score >= 0.8 THEN 'high' ELSE 'low' END AS tier, tokens AS full_tokens, CAST(ceil(length(content[1:200]) / 2.0) AS INTEGER) AS summary_tokens FROM i WHERE score >= 0.5")
def g4(spark, d):
    t = _items(spark, d).withColumn("tier", C.tier(F.col("score"), 0.8, 0.5)).where("tier is not null")
    return t.select("id", "tier", F.col("tokens").alias("full_tokens"), estimate_tokens(F.substring("content", 1, 200)).alias("summary_tokens"))


G5 = f"""WITH RECURSIVE {ITEMS}, o AS (SELECT source, id, tokens, row_number() OVER (PARTITION BY source ORDER BY score < 0.8, -score, id) AS rn FROM i),
p AS (SELECT source, rn, CASE WHEN tokens <= 3000 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 3000 THEN 0 ELSE 1 END AS dropped, CASE WHEN tokens <= 3000 THEN CAST(id AS VARCHAR) ELSE '' END AS picked FROM o WHERE rn = 1
UNION ALL SELECT o.source, o.rn, CASE WHEN tokens <= 3000 AND used + tokens <= 6000 THEN used + tokens ELSE used END, CASE WHEN tokens <= 3000 AND used + tokens <= 6000 THEN dropped ELSE dropped + 1 END,
CASE WHEN tokens <= 3000 AND used + tokens <= 6000 THEN CASE WHEN picked = '' THEN CAST(o.id AS VARCHAR) ELSE picked || ',' || o.id END ELSE picked END FROM p JOIN o ON o.source = p.source AND o.rn = p.rn + 1)
SELECT source, picked, CAST(used AS BIGINT) AS used, CAST(dropped AS BIGINT) AS dropped FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY rn DESC) = 1"""


@query("g5_budget", G5)
def g5(spark, d):
    i = _items(spark, d).withColumns({"late": F.col("score") < 0.8, "down": -F.col("score")})
    return C.pack_budget(i, "source", ["late", "down"], "tokens", 6000)


@query("g5_budget_rounds", G5)
def g5b(spark, d):
    i = _items(spark, d).withColumns({"late": F.col("score") < 0.8, "down": -F.col("score")})
    return C.pack_budget(i, "source", ["late", "down"], "tokens", 6000, fold=5)


@query("g6_rank_scores", f"WITH {ITEMS}, r AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM i) SELECT source, id, round((n - rank) / n, 9) AS rank_score, (n - rank) / n >= 2.0 / 3 AS high FROM r")
def g6(spark, d):
    r = C.with_ranks(_items(spark, d).withColumn("down", -F.col("score")), "source", ["down", "id"])
    s = C.rank_scores(F.col("rank"), F.col("n"))
    return r.select("source", "id", F.round(s, 9).alias("rank_score"), (s >= C.LEVELS["none"][1]).alias("high"))


TURNS = "m AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), t AS (SELECT conv_id, turn, question, text AS answer FROM m WHERE role = 'assistant' AND before = 'user')"


@query("g7_turns", f"WITH {TURNS} SELECT * FROM t")
def g7(spark, d):
    return C.turns(table(spark, d, "conversations"))


@query("g8_history", f"""WITH {TURNS}, a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age, ceil(length(question) / 2.0) + ceil(length(answer) / 2.0) AS cost FROM t),
u AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) + 3 AS used FROM a WHERE age <= 4)
SELECT conv_id, count(*) AS turns, '【历史对话】' || chr(10) || string_agg('用户：' || question || chr(10) || '助手：' || answer, chr(10) || chr(10) ORDER BY turn) AS history FROM u WHERE age = 1 OR used <= 800 GROUP BY conv_id""")
def g8(spark, d):
    return C.history(C.turns(table(spark, d, "conversations")), 4, 800)


@query("g9_sources", "SELECT o_custkey, o_orderpriority AS code, o_orderstatus AS clause_no, min(o_orderkey) AS place FROM orders WHERE o_orderpriority <> '' GROUP BY ALL")
def g9(spark, d):
    return C.sources(table(spark, d, "orders").withColumns({"code": F.col("o_orderpriority"), "clause_no": F.col("o_orderstatus")}), "o_custkey", "o_orderkey")


@query("g10_filtered_out", FUSED + " SELECT query_id, count(*) FILTER (lang = 'fr') AS hits, CASE WHEN count(*) FILTER (lang = 'fr') < 3 THEN count(*) END AS global_total FROM r JOIN documents USING (doc_id) GROUP BY query_id")
def g10(spark, d):
    found = fused(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return C.filtered_out(found, F.col("lang") == "fr")


@query("g11_stages", """WITH RECURSIVE i AS (SELECT user_id, value / 100 AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, length(props) * (event_id % 17) AS tokens, event_type <> 'error' AS in_force FROM events),
n AS (SELECT user_id, count(*) AS rrf_total, count(*) FILTER (in_force) AS after_meta, count(*) FILTER (in_force AND score >= 0.05) AS after_threshold FROM i GROUP BY 1),
k AS (SELECT *, CASE WHEN after_threshold < 10 THEN after_threshold ELSE least(15, greatest(10, CAST(ceil(after_threshold * 0.1) AS INTEGER))) END AS target FROM n),
p AS (SELECT i.*, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS nth FROM i WHERE in_force AND score >= 0.05),
c AS (SELECT p.*, row_number() OVER (PARTITION BY user_id ORDER BY score < 0.2, nth) AS turn FROM p JOIN k USING (user_id) WHERE nth <= target),
f AS (SELECT user_id, turn, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 200 THEN 0 ELSE 1 END AS dropped FROM c WHERE turn = 1
UNION ALL SELECT c.user_id, c.turn, CASE WHEN c.tokens <= 200 AND used + c.tokens <= 400 THEN used + c.tokens ELSE used END, CASE WHEN c.tokens <= 200 AND used + c.tokens <= 400 THEN dropped ELSE dropped + 1 END FROM f JOIN c ON c.user_id = f.user_id AND c.turn = f.turn + 1),
z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY turn DESC) = 1),
t AS (SELECT user_id, count(*) FILTER (score >= 0.2) AS high_count, count(*) FILTER (score < 0.2) AS low_count FROM c GROUP BY 1)
SELECT user_id, rrf_total, after_meta, after_threshold, CAST(target AS INTEGER) AS select_target, coalesce(high_count, 0) AS high_count, coalesce(low_count, 0) AS low_count, CAST(coalesce(used, 0) AS BIGINT) AS context_tokens, CAST(400 AS INTEGER) AS budget, CAST(coalesce(dropped, 0) AS BIGINT) AS dropped_overflow, coalesce(used, 0) = 0 AS context_empty
FROM k LEFT JOIN t USING (user_id) LEFT JOIN z USING (user_id)""")
def g11b(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    tokens = (F.length("props") * (F.col("event_id") % 17)).cast("int")
    items = table(spark, d, "events").select("user_id", (F.col("value") / 100).alias("score"), F.row_number().over(w).alias("rank"), tokens.alias("tokens"), (F.col("event_type") != "error").alias("in_force"))
    return C.stage_trace(items, "user_id", 0.2, 0.05, 400)


@query("g11_trace", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) AS after_threshold, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def g11(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("after_threshold"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("g12_sessions", "SELECT conv_id, count(text) AS messages, arg_min(trim(text)[1:20], turn) FILTER (role = 'user') AS title, max(turn) AS last FROM conversations GROUP BY conv_id")
def g12(spark, d):
    return C.sessions(table(spark, d, "conversations"))


@query("g13_message_search", "SELECT conv_id, turn, role FROM conversations WHERE contains(text, '. ') ORDER BY conv_id DESC, turn DESC LIMIT 100")
def g13(spark, d):
    return C.search_messages(table(spark, d, "conversations"), ". ").select("conv_id", "turn", "role")


@query("g14_rollup", "SELECT conv_id, CASE WHEN length(t) = 20 THEN t || '…' ELSE t END AS title FROM (SELECT conv_id, arg_min(trim(text)[1:20], turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)")
def g14(spark, d):
    s = C.sessions(table(spark, d, "conversations").where("role = 'user'"))
    return s.select("conv_id", F.when(F.length("title") == 20, F.concat("title", F.lit("…"))).otherwise(F.col("title")).alias("title"))


@query("g15_json_columns", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def g15(spark, d):
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json(broken, "k int")["k"], F.lit(0)).alias("k"))


@query("g16_prompt_inputs", "WITH c AS (SELECT doc_id, doc_id // 20 AS batch, trim(text)[1:200] AS t FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id) AS i FROM c) SELECT batch, string_agg(i || '. ' || t, chr(10) ORDER BY doc_id) AS lines FROM n GROUP BY batch")
def g16(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 20").alias("batch"), F.col("text").alias("content"))
    return C.prompt_inputs(c, "batch", "doc_id")


@query("g17_session_edits", "SELECT conv_id, count(*) AS messages, any_value(CASE WHEN conv_id % 3 = 1 THEN 'renamed ' || conv_id ELSE 'session' END) AS title FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id")
def g17(spark, d):
    m = table(spark, d, "conversations")
    edits = m.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 5 == 0).alias("gone"), F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit("renamed "), F.col("conv_id").cast("string"))).otherwise("  ").alias("name"))
    kept = m.join(edits.where("gone"), "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("messages"))
    return kept.join(edits, "conv_id").select("conv_id", "messages", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("session")).alias("title"))


@query("g18_effective_filters", """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '{"lang":"en"' || CASE WHEN item_id % 3 = 0 THEN ',"status":""' ELSE '' END || '}' ELSE CASE WHEN item_id % 3 = 0 THEN '{"status":""}' ELSE '{}' END END AS filters, contains(text, 'the') AS notes FROM benchmark""")
def g18(spark, d):
    k = F.col("item_id")
    f = F.struct(F.when(k % 2 == 0, "en").alias("lang"), F.when(k % 3 == 0, "").alias("status"))
    return table(spark, d, "benchmark").select("item_id", F.to_json(f).alias("filters"), F.col("text").rlike("the").alias("notes"))


@query("a11_export_conversation", "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '## 问' ELSE '## 答' END || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id")
def a11(spark, d):
    return C.export_conversation(table(spark, d, "conversations"))
