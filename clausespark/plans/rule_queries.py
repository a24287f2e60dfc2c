"""Queries of rules and review (F): documents are clauses, part the rules, lineitem the pending words, orders the queue."""

from pyspark.sql import functions as F

from clausespark.operators import rules as R
from clausespark.plans.data import clauses, sql_values, table, values
from clausespark.plans.registry import query

RULES = [
    (1, "dim4", "the", "keyword", 0, 0.45, "en", 1), (2, "dim4", "der", "keyword", 0, 0.6, "de", 1), (3, "dim4", "que", "keyword", 1, 0.6, "es", 1),
    (4, "dim4", "aux", "keyword", 1, 0.6, None, 1), (5, "dim5", "[0-9]+", "regex", 2, 0.01, "numbers", 1), (6, "dim5", "tion|ción", "regex", 0, 0.05, "tion", 1),
    (7, "dim6", "License", "keyword", 3, 0.5, "licence", 1), (8, "dim6", "Con.", "exact", 0, 0.6, "short", 1), (9, "dim6", "the", "keyword", 5, 0.6, "off", 0),
]
SCHEMA = "id long, dimension string, pattern string, match_type string, priority int, threshold double, label string, is_active int"
NAMES = "id, dimension, pattern, match_type, priority, threshold, label, is_active"

RULE_SQL = f"r({NAMES}) AS ({sql_values(RULES)})"
COUNT = "CAST((length(content) - length(replace(content, pattern, ''))) / length(pattern) AS INTEGER)"
SCORE = f"""CASE match_type WHEN 'exact' THEN CASE WHEN pattern = trim(content) THEN 1 + 0.1 * priority ELSE 0 END
WHEN 'regex' THEN least(1.0, coalesce(list_sum([length(x) FOR x IN regexp_extract_all(content, pattern)]), 0)::DOUBLE / greatest(length(content), 1) * 2) * (1 + 0.1 * priority)
ELSE CASE WHEN {COUNT} = 0 THEN 0 ELSE least(1.0, 0.3::DOUBLE + {COUNT} * 0.15::DOUBLE) * (1 + 0.1::DOUBLE * priority) END END"""
SCORED = f"""{RULE_SQL}, c AS (SELECT doc_id AS id, text AS content FROM documents),
s AS (SELECT c.id, r.id AS rule_id, dimension, pattern, match_type, priority, threshold, label, content, CAST({SCORE} AS DOUBLE) AS score FROM c, r WHERE is_active = 1)"""
GATE = "(CASE dimension WHEN 'dim1' THEN 0.3 WHEN 'dim2' THEN 0.5 WHEN 'dim3' THEN 0.5 WHEN 'dim5' THEN 0.7 ELSE 0.6 END)"
BEST = f"""WITH {SCORED}, t AS (SELECT *, row_number() OVER (PARTITION BY id, dimension ORDER BY score DESC, rule_id) AS i FROM s WHERE score >= threshold AND score > 0),
best AS (SELECT id, dimension, score, coalesce(label, pattern) AS label, rule_id FROM t WHERE i = 1)"""

PART = """rules AS (SELECT p_partkey AS id, 'dim' || (4 + p_size % 3) AS dimension, p_brand AS sub_field, 'p' || p_partkey % 700 AS pattern, p_size - 1 AS hit_count, (p_size - 1) * (p_partkey % 6) // 5 AS confirmed,
CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS is_active, CASE WHEN p_partkey % 10 = 0 THEN 1 WHEN p_partkey % 10 = 1 THEN NULL ELSE 0 END AS locked, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'L' || p_partkey % 8 END AS label,
p_size % 5 AS priority, 0.6 AS threshold, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (p_partkey % 90) AS created_at FROM part)"""
PENDING = """pending AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'dim4' WHEN 'N' THEN 'dim5' ELSE 'dim6' END AS dimension, 'p' || l_partkey % 700 AS pattern, 'L' || l_suppkey % 5 AS label,
CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_orderkey END AS clause_id, CAST(round(l_discount * 100) AS BIGINT)::DOUBLE AS ai_confidence, CASE WHEN l_linestatus = 'O' THEN 'pending' WHEN l_linenumber % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, l_shipdate AS created_at FROM lineitem)"""
QUEUE = """queue AS (SELECT o_orderkey AS id, o_orderkey AS clause_id, 'dim' || (4 + o_orderkey % 3) AS dimension, o_totalprice / 1000000 AS keyword_score, CASE o_orderstatus WHEN 'O' THEN 'review' WHEN 'F' THEN 'pending' ELSE 'done' END AS status, 'A' || o_custkey % 4 AS ai_label, o_orderdate AS created_at FROM orders)"""
ALL = f"WITH {PART}, {PENDING}, {QUEUE}"


def literal_rules(spark):
    return values(spark, RULES, SCHEMA)


def rules(spark, d):
    k = F.col("p_partkey")
    size = F.col("p_size") - 1
    return table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("dim"), (F.col("p_size") % 3 + 4).cast("string")).alias("dimension"), F.col("p_brand").alias("sub_field"), F.concat(F.lit("p"), (k % 700).cast("string")).alias("pattern"),
        size.alias("hit_count"), F.floor(size * (k % 6) / 5).cast("long").alias("confirmed"), F.when(k % 4 == 0, 0).otherwise(1).alias("is_active"), F.when(k % 10 == 0, 1).when(k % 10 != 1, 0).alias("locked"),
        F.when(k % 3 != 0, F.concat(F.lit("L"), (k % 8).cast("string"))).alias("label"), (F.col("p_size") % 5).alias("priority"), F.lit(0.6).alias("threshold"),
        F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(p_partkey % 90 as int))").alias("created_at"),
    )


def pending(spark, d):
    text = lambda c: F.col(c).cast("string")
    del text
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_returnflag") == "A", "dim4").when(F.col("l_returnflag") == "N", "dim5").otherwise("dim6").alias("dimension"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 700).cast("string")).alias("pattern"), F.concat(F.lit("L"), (F.col("l_suppkey") % 5).cast("string")).alias("label"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_orderkey")).alias("clause_id"), F.round(F.col("l_discount") * 100).alias("ai_confidence"),
        F.when(F.col("l_linestatus") == "O", "pending").when(F.col("l_linenumber") % 2 == 0, "approved").otherwise("rejected").alias("status"), F.col("l_shipdate").alias("created_at"),
    )


def queue(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("clause_id"), F.concat(F.lit("dim"), (F.col("o_orderkey") % 3 + 4).cast("string")).alias("dimension"), (F.col("o_totalprice") / 1000000).alias("keyword_score"),
        F.when(F.col("o_orderstatus") == "O", "review").when(F.col("o_orderstatus") == "F", "pending").otherwise("done").alias("status"), F.concat(F.lit("A"), (F.col("o_custkey") % 4).cast("string")).alias("ai_label"), F.col("o_orderdate").alias("created_at"),
    )


def _best(spark, d):
    return R.classify(clauses(spark, d), literal_rules(spark))


for _name, _kind in (("f1_keyword_score", "keyword"), ("f2_regex_score", "regex"), ("f3_exact_score", "exact")):

    @query(_name, f"WITH {SCORED} SELECT id, rule_id, round(score, 9) AS score FROM s WHERE match_type = '{_kind}' AND score > 0")
    def f1(spark, d, kind=_kind):
        r = literal_rules(spark).where(F.col("match_type") == kind).withColumnRenamed("id", "rule_id")
        return R.scores(clauses(spark, d).select("id", "content"), r).select("id", "rule_id", F.round("score", 9).alias("score"))


@query("f4_classify", BEST + " SELECT id, dimension, round(score, 9) AS score, label, rule_id FROM best")
def f4(spark, d):
    return _best(spark, d).withColumn("score", F.round("score", 9)).select("id", "dimension", "score", "label", "rule_id")


@query("f5_needs_ai", BEST + f" SELECT dimension, score < {GATE} AS needs_ai, count(*) AS n FROM best GROUP BY ALL")
def f5(spark, d):
    return R.needs_ai(_best(spark, d)).groupBy("dimension", "needs_ai").agg(F.count("*").alias("n"))


@query("f6_classify_specs", f"""WITH {RULE_SQL}, c AS (SELECT p_partkey AS id, p_brand || ' ' || p_name AS content FROM part), k(pattern, label) AS (VALUES ('Brand#1', 'one'), ('ea', 'ea')),
s AS (SELECT id, label, least(1.0, 0.3::DOUBLE + {COUNT} * 0.15::DOUBLE) AS score, pattern FROM c, k WHERE contains(content, pattern))
SELECT id, arg_max(label, score * 10 - CASE label WHEN 'one' THEN 0 ELSE 0.001 END) AS label FROM s WHERE score >= 0.4 GROUP BY id""")
def f6(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name").alias("content"))
    r = values(spark, [(1, "dim2", "Brand#1", "keyword", 0, 0.4, "one", 1), (2, "dim2", "ea", "keyword", 0, 0.4, "ea", 1)], SCHEMA)
    return R.classify(c, r).select("id", "label")


@query("f7_hits", BEST + f", w AS (SELECT rule_id, count(*) AS h, count(*) FILTER (score >= {GATE}) AS c FROM best GROUP BY 1) SELECT r.id, CAST(10 + coalesce(h, 0) AS BIGINT) AS hit_count, CAST(1 + coalesce(c, 0) AS BIGINT) AS confirmed FROM r LEFT JOIN w ON r.id = rule_id")
def f7(spark, d):
    return R.accumulate_hits(literal_rules(spark).withColumns({"hit_count": F.lit(10), "confirmed": F.lit(1)}), _best(spark, d))


@query("f8_enqueue", f"""{ALL}, c AS (SELECT doc_id AS clause_id, toxic AS clause_is_non, CASE WHEN quality = 0 THEN '废止' ELSE '现行' END AS status FROM labels), w AS (SELECT clause_id, dimension, ai_confidence AS keyword_score FROM pending)
SELECT clause_id, dimension, min(keyword_score) AS keyword_score FROM w SEMI JOIN (SELECT * FROM c WHERE clause_is_non = 0 AND status <> '废止') USING (clause_id) ANTI JOIN queue USING (clause_id, dimension) GROUP BY ALL""")
def f8(spark, d):
    c = table(spark, d, "labels").select(F.col("doc_id").alias("clause_id"), F.col("toxic").alias("clause_is_non"), F.when(F.col("quality") == 0, "废止").otherwise("现行").alias("status"))
    return R.enqueue(pending(spark, d).select("clause_id", "dimension", F.col("ai_confidence").alias("keyword_score")), c, queue(spark, d))


@query("f9_batches", ALL + """, b AS (SELECT id, dimension, CAST(ceil(row_number() OVER (PARTITION BY dimension ORDER BY created_at, id) / 20.0) AS INTEGER) AS batch FROM queue WHERE status = 'pending')
SELECT id, dimension, batch FROM b QUALIFY count(*) OVER (PARTITION BY dimension, batch) = 20""")
def f9(spark, d):
    return R.draw_batches(queue(spark, d), 20)


STATE = """, ks AS (SELECT dimension, pattern, label, max(CASE status WHEN 'rejected' THEN 2 WHEN 'approved' THEN 1 ELSE 0 END) AS s FROM pending GROUP BY ALL),
rs AS (SELECT dimension, pattern, bool_or(label IS NULL) AS any_label, list(DISTINCT label) AS labels FROM rules WHERE confirmed > 0 AND is_active = 1 GROUP BY ALL),
keys AS (SELECT DISTINCT dimension, pattern, 'L' || l_suppkey % 6 AS label FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'dim4' WHEN 'N' THEN 'dim5' ELSE 'dim6' END AS dimension, 'p' || l_partkey % 900 AS pattern, l_suppkey FROM lineitem)),
states AS (SELECT k.*, CASE WHEN s = 2 THEN 'rejected' WHEN s = 1 OR coalesce(any_label, false) OR coalesce(list_contains(labels, k.label), false) THEN 'approved' ELSE 'none' END AS state FROM keys k LEFT JOIN ks USING (dimension, pattern, label) LEFT JOIN rs USING (dimension, pattern))"""


def _keys(spark, d):
    dim = F.when(F.col("l_returnflag") == "A", "dim4").when(F.col("l_returnflag") == "N", "dim5").otherwise("dim6")
    return table(spark, d, "lineitem").select(dim.alias("dimension"), F.concat(F.lit("p"), (F.col("l_partkey") % 900).cast("string")).alias("pattern"), F.concat(F.lit("L"), (F.col("l_suppkey") % 6).cast("string")).alias("label")).distinct()


@query("f10_adjudicate", ALL + STATE + """, res AS (SELECT clause_id, dimension, ai_label, keyword_score * 2 AS conf FROM queue), ck AS (SELECT p.clause_id, p.dimension, bool_or(coalesce(state, 'none') = 'approved') AS a FROM pending p LEFT JOIN states USING (dimension, pattern, label) WHERE clause_id IS NOT NULL GROUP BY ALL)
SELECT clause_id, dimension, ai_label, CASE WHEN conf >= 0.7 AND coalesce(a, true) THEN 'auto_adopted' ELSE 'review' END AS outcome FROM res LEFT JOIN ck USING (clause_id, dimension)""")
def f10(spark, d):
    states = R.key_states(_keys(spark, d), pending(spark, d), rules(spark, d)).withColumn("state", F.col("state"))
    res = queue(spark, d).select("clause_id", "dimension", "ai_label", (F.col("keyword_score") * 2).alias("ai_confidence"))
    keys = pending(spark, d).where("clause_id is not null").select("clause_id", "dimension", "pattern", "label")
    return R.adjudicate(res, keys.join(states, ["dimension", "pattern", "label"], "left").fillna("none", ["state"]).drop("state"), keys.select("dimension", "pattern", "label").distinct().join(states, ["dimension", "pattern", "label"], "left").fillna("none", ["state"]))


@query("f11_key_states", ALL + STATE + " SELECT dimension, pattern, label, state FROM states")
def f11(spark, d):
    return R.key_states(_keys(spark, d), pending(spark, d), rules(spark, d))


@query("f12_insert_pending", ALL + """, n AS (SELECT DISTINCT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_orderkey END AS clause_id, 'dim5' AS dimension, 'p' || l_partkey % 700 AS pattern, 'L' || l_suppkey % 5 AS label FROM lineitem)
SELECT clause_id, dimension, pattern, label FROM n WHERE NOT EXISTS (SELECT 1 FROM pending p WHERE p.clause_id IS NOT DISTINCT FROM n.clause_id AND p.dimension = n.dimension AND p.pattern = n.pattern AND p.label = n.label)""")
def f12(spark, d):
    return R.insert_pending(pending(spark, d).withColumn("dimension", F.lit("dim5")), pending(spark, d))


KEYS = ", keys AS (SELECT DISTINCT dimension, pattern, label FROM pending WHERE id % 97 = 1)"

for _action, (_yes, _no) in {"approve": ("approved", "rejected"), "reject": ("rejected", "approved")}.items():

    @query(f"f13_decide_{_action}", ALL + KEYS + f""" SELECT id, CASE WHEN status <> 'pending' THEN status WHEN k.label IS NOT NULL THEN '{_yes}' WHEN w.pattern IS NOT NULL THEN '{_no}' ELSE status END AS status
FROM pending LEFT JOIN keys k USING (dimension, pattern, label) LEFT JOIN (SELECT DISTINCT dimension, pattern FROM keys) w USING (dimension, pattern)""")
    def f13(spark, d, action=_action):
        p = pending(spark, d)
        return R.decide_words(p, p.where("id % 97 = 1").select("id"), action)


@query("f14_backfill", ALL + KEYS + " SELECT clause_id, dimension, min(label) AS label FROM pending SEMI JOIN keys USING (dimension, pattern, label) SEMI JOIN (SELECT * FROM queue WHERE status = 'review') q USING (clause_id, dimension) GROUP BY ALL")
def f14(spark, d):
    p = pending(spark, d)
    return R.backfill(p, queue(spark, d), p.where("id % 97 = 1").select("dimension", "pattern", "label").distinct())


@query("f15_decide_queue", ALL + """, x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'confirm' ELSE 'reject' END AS action, 'N' || o_custkey % 3 AS nl FROM orders WHERE o_orderkey % 5 < 2)
SELECT id, CASE WHEN action = 'confirm' AND status = 'review' THEN 'done' WHEN action = 'reject' THEN 'rejected' ELSE status END AS status, CASE WHEN action = 'confirm' AND status = 'review' THEN nl WHEN action = 'reject' THEN NULL ELSE ai_label END AS label FROM queue LEFT JOIN x USING (id)""")
def f15(spark, d):
    x = table(spark, d, "orders").where("o_orderkey % 5 < 2").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "confirm").otherwise("reject").alias("action"), F.concat(F.lit("N"), (F.col("o_custkey") % 3).cast("string")).alias("label"))
    return R.decide_queue(queue(spark, d), x)


@query("f16_decide_clauses", ALL + """, x AS (SELECT clause_id, dimension, 'L1' AS nl FROM queue WHERE status = 'review')
SELECT p.id, CASE WHEN p.id % 2 = 1 AND label = nl THEN 'approved' ELSE 'rejected' END AS status FROM pending p JOIN x USING (clause_id, dimension) WHERE p.status = 'pending'""")
def f16(spark, d):
    p = pending(spark, d)
    odd = p.where("id % 2 = 1").groupBy("clause_id", "dimension").agg(F.collect_set("id").alias("ticked"))
    x = queue(spark, d).where("status = 'review'").select("clause_id", "dimension", F.lit("L1").alias("new_label")).join(odd, ["clause_id", "dimension"], "left").withColumn("ticked", F.coalesce("ticked", F.array().cast("array<long>")))
    return R.decide_clauses(p, x)[0]


UNIQUE = ", u AS (SELECT * FROM rules QUALIFY row_number() OVER (PARTITION BY dimension, pattern ORDER BY id) = 1)"


def _unique(spark, d):
    r = rules(spark, d)
    return r.join(r.groupBy("dimension", "pattern").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")


@query("f17_bump_rules", ALL + UNIQUE + """, b AS (SELECT dimension, pattern, count(*) AS h, count(*) FILTER (status = 'approved') AS c, min(label) AS nl FROM pending WHERE status <> 'rejected' GROUP BY ALL),
j AS (SELECT dimension, pattern, id, coalesce(hit_count, 0) + coalesce(h, 0) AS hit, coalesce(confirmed, 0) + coalesce(c, 0) AS sure, coalesce(locked, 0) = 0 AS free, h, is_active, label, nl, threshold FROM u FULL JOIN b USING (dimension, pattern))
SELECT dimension, pattern, CAST(hit AS BIGINT) AS hit_count, CAST(sure AS BIGINT) AS confirmed, CASE WHEN id IS NULL THEN 0 WHEN h IS NULL OR NOT free THEN is_active WHEN sure / greatest(hit, 1) >= 0.8 AND hit >= 5 THEN 1 WHEN sure > 0 AND sure / greatest(hit, 1) < 0.3 AND hit > 10 THEN 0 ELSE is_active END AS is_active,
CASE WHEN free THEN coalesce(label, nl) ELSE label END AS label, CAST(coalesce(threshold, 0.6) AS DOUBLE) AS threshold FROM j""")
def f17(spark, d):
    b = pending(spark, d).where("status <> 'rejected'").select("dimension", "pattern", "label", (F.col("status") == "approved").alias("human"))
    return R.bump_rules(_unique(spark, d), b)


@query("f18_switch_rules", ALL + """, n AS (SELECT DISTINCT dimension, pattern, true AS no FROM pending WHERE status = 'rejected' AND id % 3 = 0), y AS (SELECT DISTINCT dimension, pattern, true AS yes FROM pending WHERE status = 'approved' AND id % 3 = 1)
SELECT id, CASE WHEN no AND confirmed = 0 THEN 0 WHEN yes AND confirmed > 0 THEN 1 ELSE is_active END AS is_active FROM rules LEFT JOIN n USING (dimension, pattern) LEFT JOIN y USING (dimension, pattern)""")
def f18(spark, d):
    p = pending(spark, d)
    return R.switch_rules(rules(spark, d), p.where("status = 'rejected' and id % 3 = 0"), p.where("status = 'approved' and id % 3 = 1"))


@query("f19_word_groups", ALL + """, p AS (SELECT * FROM pending WHERE status = 'pending'), l AS (SELECT dimension, pattern, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS labels FROM (SELECT dimension, pattern, label, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL)
SELECT dimension, pattern, count(DISTINCT clause_id) AS clauses, round(avg(ai_confidence), 3) AS confidence, any_value(labels) AS labels FROM p JOIN l USING (dimension, pattern) GROUP BY dimension, pattern""")
def f19(spark, d):
    return R.word_groups(pending(spark, d))


GROUPS = "SELECT dimension, clause_id, count(*) AS n, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS words"
REVIEW = "SEMI JOIN (SELECT * FROM queue WHERE status = 'review') q USING (clause_id, dimension)"
NO_PENDING = "ANTI JOIN (SELECT * FROM pending WHERE status = 'pending') x USING (clause_id, dimension)"
F20 = f"{GROUPS} FROM (SELECT * FROM pending WHERE status = 'pending') p {REVIEW} GROUP BY dimension, clause_id"
F21 = f"{GROUPS} FROM (SELECT * FROM pending WHERE status = 'rejected') p {NO_PENDING} {REVIEW} GROUP BY dimension, clause_id"
F22 = "SELECT id, clause_id, dimension, created_at FROM (SELECT * FROM queue WHERE status = 'review') q ANTI JOIN (SELECT * FROM pending WHERE status IN ('pending', 'rejected')) x USING (clause_id, dimension)"


@query("f20_clause_groups", f"{ALL} {F20}")
def f20(spark, d):
    return R.clause_groups(pending(spark, d), queue(spark, d))


@query("f21_rejected_groups", f"{ALL} {F21}")
def f21(spark, d):
    return R.clause_groups(pending(spark, d), queue(spark, d), "rejected")


@query("f22_fallback_items", f"{ALL} {F22} ORDER BY created_at DESC, id DESC LIMIT 50")
def f22(spark, d):
    return R.fallback_items(pending(spark, d), queue(spark, d)).orderBy(F.desc("created_at"), F.desc("id")).limit(50)


@query("f23_pending_counts", f"{ALL}, a AS ({F20}), b AS ({F21}), c AS ({F22}) SELECT 'clause' AS kind, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) + (SELECT count(*) FROM c) AS n UNION ALL SELECT 'word', count(*) FROM (SELECT DISTINCT dimension, pattern FROM pending WHERE status = 'pending')")
def f23(spark, d):
    return R.pending_counts(pending(spark, d), queue(spark, d))


@query("f24_blacklist", ALL + " SELECT dimension, pattern, label, count(*) AS n, count(DISTINCT clause_id) AS clauses, max(created_at) AS last, min(id) AS id FROM pending WHERE status = 'rejected' GROUP BY dimension, pattern, label")
def f24(spark, d):
    return R.blacklist(pending(spark, d))


@query("f24_restore", ALL + KEYS + " SELECT id, CASE WHEN k.label IS NOT NULL AND status = 'rejected' THEN 'pending' ELSE status END AS status FROM pending LEFT JOIN keys k USING (dimension, pattern, label)")
def f24b(spark, d):
    p = pending(spark, d)
    return R.restore_words(p, p.where("id % 97 = 1").select("id"), "pending")


@query("f25_label_candidates", ALL + """, v AS (SELECT dimension, coalesce(label, pattern) AS v, 0 AS o, -priority AS x, -hit_count AS y, id FROM rules WHERE is_active = 1 UNION ALL SELECT dimension, label || ', ' || pattern, 1, 0, 0, 0 FROM pending),
s AS (SELECT dimension, trim(unnest(string_split(v, ','))) AS label, generate_subscripts(string_split(v, ','), 1) AS p, o, x, y, id FROM v), f AS (SELECT dimension, label, min((o, x, y, id, p)) AS first FROM s WHERE label <> '' GROUP BY ALL)
SELECT dimension, label, CAST(row_number() OVER (PARTITION BY dimension ORDER BY first, label) AS INTEGER) AS rank FROM f QUALIFY rank <= 40""")
def f25(spark, d):
    return R.label_candidates(rules(spark, d), pending(spark, d).select("dimension", F.concat_ws(", ", "label", "pattern").alias("label")))


@query("f26_pending_statistics", ALL + " SELECT dimension, count(*) AS n, count(DISTINCT clause_id) AS clauses FROM pending WHERE status = 'pending' GROUP BY GROUPING SETS ((), (dimension))")
def f26(spark, d):
    return R.pending_statistics(pending(spark, d))


@query("f27_queue_matrix", ALL + " SELECT dimension, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'done') AS done, count(*) AS total FROM queue GROUP BY dimension")
def f27(spark, d):
    return R.queue_matrix(queue(spark, d), ["pending", "review", "done"])


@query("f28_rule_statistics", ALL + " SELECT dimension, coalesce(label, '') AS label, count(*) AS n, count(*) FILTER (is_active = 1) AS active, CAST(sum(hit_count) AS BIGINT) AS hits, count(DISTINCT sub_field) AS sub_fields FROM rules GROUP BY ALL")
def f28(spark, d):
    return R.rule_statistics(rules(spark, d))


F29 = """SELECT 'suggest_enable' AS kind, id FROM rules WHERE is_active = 0 AND confirmed / greatest(hit_count, 1) >= 0.8 AND hit_count >= 5
UNION ALL SELECT 'suggest_disable', id FROM rules WHERE is_active = 1 AND confirmed > 0 AND confirmed / greatest(hit_count, 1) < 0.3 AND hit_count > 10
UNION ALL SELECT 'zombie', id FROM rules WHERE hit_count = 0 AND coalesce(locked, 0) = 0 AND created_at < TIMESTAMP '2024-03-01' - INTERVAL 30 DAY"""


@query("f29_rule_quality", f"{ALL} {F29}")
def f29(spark, d):
    return R.rule_quality(rules(spark, d), "2024-03-01 00:00:00")


@query("f30_quality_action", f"{ALL}, q AS ({F29}) SELECT id, CASE WHEN id IN (SELECT id FROM q WHERE kind = 'suggest_enable') THEN 1 ELSE is_active END AS is_active FROM rules WHERE id NOT IN (SELECT id FROM q WHERE kind = 'zombie')")
def f30(spark, d):
    r = rules(spark, d)
    report = R.rule_quality(r, "2024-03-01 00:00:00")
    return R.quality_action(R.quality_action(r, report, "suggest_enable", "enable"), report, "zombie", "delete").select("id", "is_active")


@query("f31_duplicate_rules", ALL + """ SELECT id, dimension, pattern, CAST(sum(hit_count) OVER w AS BIGINT) AS hit_count, CAST(sum(confirmed) OVER w AS BIGINT) AS confirmed FROM rules
WINDOW w AS (PARTITION BY dimension, pattern) QUALIFY row_number() OVER (PARTITION BY dimension, pattern ORDER BY label IS NULL, hit_count + confirmed DESC, id) = 1""")
def f31(spark, d):
    return R.resolve_duplicate_rules(rules(spark, d))


@query("f32_orphan_labels", ALL + " SELECT clause_id, dimension, ai_label AS label FROM queue WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE is_active = 1 AND r.dimension = queue.dimension AND replace(coalesce(r.label, r.pattern), 'L', 'A') = ai_label AND coalesce(r.locked, 0) = 1)")
def f32(spark, d):
    r = rules(spark, d).where("locked = 1").withColumns({"label": F.replace("label", F.lit("L"), F.lit("A")), "pattern": F.replace("pattern", F.lit("L"), F.lit("A"))})
    return R.orphan_labels(queue(spark, d).withColumnRenamed("ai_label", "label"), r)


@query("f33_disable_unconfirmed", ALL + " SELECT id, CASE WHEN confirmed = 0 AND coalesce(locked, 0) = 0 THEN 0 ELSE is_active END AS is_active FROM rules")
def f33(spark, d):
    return R.disable_unconfirmed(rules(spark, d))


@query("f33_fragments", ALL + """, n AS (SELECT DISTINCT NULL::BIGINT AS clause_id, dimension, pattern, coalesce(label, pattern) AS label FROM rules WHERE confirmed = 0 AND is_active = 1 AND coalesce(locked, 0) = 0)
SELECT clause_id, dimension, pattern, label FROM n WHERE NOT EXISTS (SELECT 1 FROM pending p WHERE p.clause_id IS NULL AND p.dimension = n.dimension AND p.pattern = n.pattern AND p.label = n.label)""")
def f33b(spark, d):
    return R.fragments_to_review(rules(spark, d), pending(spark, d))


@query("f34_reclassify", "SELECT doc_id AS clause_id, unnest(['dim4', 'dim5', 'dim6']) AS dimension FROM documents LEFT JOIN labels USING (doc_id) WHERE source IN ('src1', 'src3') AND quality IS NULL")
def f34(spark, d):
    c = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("clause_id"), F.col("source").alias("spec"), F.col("quality").cast("string").alias("label"))
    return R.reclassify(c, values(spark, [("src1",), ("src3",)], "spec string"), ["dim4", "dim5", "dim6"], True)


@query("f35_what_if", f"""WITH {SCORED}, o AS (SELECT id, dimension, score, CASE match_type WHEN 'keyword' THEN least(1.0, 0.3::DOUBLE + 0.25::DOUBLE * {COUNT}) * (1 + 0.1::DOUBLE * priority) ELSE score END AS other FROM s WHERE score > 0),
b AS (SELECT id, dimension, max(score) AS score, max(other) AS other FROM o GROUP BY ALL), t AS (SELECT count(*) AS total FROM documents)
SELECT dimension, any_value(total) - count(*) AS none, count(*) - count(*) FILTER (score >= {GATE}) AS below, count(*) FILTER (score >= {GATE}) AS passes, count(*) FILTER (other >= {GATE}) AS other_passes FROM b, t GROUP BY dimension""")
def f35(spark, d):
    return R.threshold_what_if(clauses(spark, d), literal_rules(spark))


@query("f36_create_rules", ALL + """, n AS (SELECT s_suppkey AS id, 'dim' || (4 + s_suppkey % 3) AS dimension, 'p' || s_suppkey * 9 AS pattern, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'x' END AS label FROM supplier)
SELECT id, dimension, pattern, label, NOT EXISTS (SELECT 1 FROM rules r WHERE r.dimension = n.dimension AND r.pattern = n.pattern) AS created FROM n""")
def f36(spark, d):
    k = F.col("s_suppkey")
    new = table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("dim"), (k % 3 + 4).cast("string")).alias("dimension"), F.concat(F.lit(" p"), (k * 9).cast("string"), F.lit(" ")).alias("pattern"), F.when(k % 2 == 0, "  ").otherwise(" x ").alias("label"))
    ok, refused = R.create_rules(rules(spark, d), new)
    cols = ["id", "dimension", "pattern", "label"]
    return ok.select(*cols, F.lit(True).alias("created")).union(refused.select(*cols, F.lit(False)))


@query("f2_bad_patterns", "SELECT doc_id AS id, 1 AS rule_id, least(1.0, 2.0 * length(regexp_replace(text, '[^e]', '', 'g')) / greatest(length(text), 1)) AS score FROM documents WHERE contains(text, 'e')")
def f2b(spark, d):
    bad = values(spark, [(1, "dim4", "e", "regex", 0, 0.1, "e", 1), (2, "dim4", "(e", "regex", 0, 0.1, "bad", 1)], SCHEMA)
    return R.scores(clauses(spark, d), bad.withColumnRenamed("id", "rule_id")).select("id", "rule_id", "score")


@query("f3_exact_names", """WITH r AS (SELECT p_partkey AS rule_id, p_name AS pattern, p_size % 3 AS priority FROM part WHERE p_partkey % 4 = 0)
SELECT p_partkey AS id, rule_id, round(1 + 0.1::DOUBLE * priority, 9) AS score FROM part JOIN r ON trim(' ' || p_name || '  ') = pattern""")
def f3b(spark, d):
    """Names of parts between spaces as clauses, every fourth name as an exact rule."""
    p = table(spark, d, "part")
    rules_ = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("rule_id"), F.lit("dim4").alias("dimension"), F.col("p_name").alias("pattern"), F.lit("exact").alias("match_type"), (F.col("p_size") % 3).alias("priority"), F.lit(0.5).alias("threshold"), F.lit("x").alias("label"), F.lit(1).alias("is_active"))
    c = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("content"))
    return R.scores(c, rules_).select("id", "rule_id", F.round("score", 9).alias("score"))


@query("f1_many_patterns", """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS pattern FROM documents WHERE doc_id % 10 = 0), r AS (SELECT pattern FROM w WHERE length(pattern) > 6)
SELECT doc_id AS id, count(*) AS rules, round(sum(least(1.0, 0.3::DOUBLE + CAST((length(text) - length(replace(text, pattern, ''))) / length(pattern) AS INTEGER) * 0.15::DOUBLE)), 6) AS score FROM documents JOIN r ON contains(text, pattern) GROUP BY doc_id""")
def f1b(spark, d):
    """Every long word of a tenth of the documents as a keyword rule, on all documents."""
    words = table(spark, d, "documents").where("doc_id % 10 = 0").select(F.explode(F.split("text", " ", -1)).alias("pattern")).where("length(pattern) > 6").distinct()
    r = words.select(F.xxhash64("pattern").alias("rule_id"), F.lit("dim4").alias("dimension"), "pattern", F.lit("keyword").alias("match_type"), F.lit(0).alias("priority"), F.lit(0.5).alias("threshold"), F.lit("x").alias("label"), F.lit(1).alias("is_active"))
    return R.scores(clauses(spark, d), r).groupBy("id").agg(F.count("*").alias("rules"), F.round(F.sum("score"), 6).alias("score"))


@query("f10_batch", """WITH k AS (SELECT doc_id AS clause_id, unnest([source, lang, 'batch']) AS pattern, lang AS label, doc_id % 10 / 10.0 AS conf FROM documents),
s AS (SELECT *, CASE WHEN pattern = 'batch' THEN 'none' WHEN pattern = 'src3' THEN 'rejected' WHEN pattern = lang2 THEN 'approved' ELSE 'none' END AS state FROM (SELECT *, CASE WHEN label IN ('en', 'de') THEN label END AS lang2 FROM k) WHERE conf >= 0.7)
SELECT doc_id AS clause_id, CASE WHEN doc_id % 10 >= 7 AND lang IN ('en', 'de') THEN 'auto_adopted' ELSE 'review' END AS outcome, (SELECT count(*) FROM s WHERE s.clause_id = doc_id AND state = 'none') AS added, (SELECT count(*) FROM s WHERE s.clause_id = doc_id AND state = 'approved') AS bumped FROM documents""")
def f10b(spark, d):
    docs = table(spark, d, "documents")
    results = docs.select(F.col("doc_id").alias("clause_id"), F.lit("dim4").alias("dimension"), F.col("lang").alias("ai_label"), (F.col("doc_id") % 10 / 10).alias("ai_confidence"))
    contents = docs.select(F.col("doc_id").alias("clause_id"), F.concat_ws(" ", "source", "lang", "source", F.lit("batch of <b>12</b>"), F.lit("规定")).alias("content"))
    contents = contents.withColumn("content", F.replace("content", F.lit(" of "), F.lit(" ")))
    langs = docs.select(F.col("lang").alias("label")).distinct()
    known = langs.where("label in ('en', 'de')").select(F.lit(None).cast("long").alias("clause_id"), F.lit("dim4").alias("dimension"), F.col("label").alias("pattern"), "label", F.lit("approved").alias("status"))
    no = langs.select(F.lit(None).cast("long").alias("clause_id"), F.lit("dim4").alias("dimension"), F.lit("src3").alias("pattern"), "label", F.lit("rejected").alias("status"))
    outcomes, fresh, _ = R.adjudicate_batch(results, contents, known.union(no), rules(spark, d).limit(0))
    bumped = outcomes.where("outcome = 'auto_adopted'").select("clause_id", F.lit(1).cast("long").alias("bumped"))
    added = fresh.groupBy("clause_id").agg(F.count("*").alias("added"))
    out = outcomes.select("clause_id", "outcome").join(added, "clause_id", "left").join(bumped, "clause_id", "left")
    return out.fillna(0, ["added", "bumped"])


@query("f36_edit_rules", ALL + """, e AS (SELECT *, CASE id % 7 WHEN 0 THEN 'toggle' WHEN 1 THEN 'lock' WHEN 2 THEN 'delete' END AS action FROM rules),
w AS (SELECT id, dimension, CASE WHEN id % 11 = 4 THEN 'p' || (id + 1) % 700 ELSE 'q' || id END AS pattern FROM rules WHERE id % 11 IN (4, 5)),
bad AS (SELECT w.id FROM w WHERE EXISTS (SELECT 1 FROM rules r WHERE r.dimension = w.dimension AND r.pattern = w.pattern AND r.id <> w.id))
SELECT e.id, CASE WHEN w.id IS NOT NULL AND bad.id IS NULL THEN w.pattern ELSE e.pattern END AS pattern, CASE WHEN action = 'toggle' THEN 1 - is_active ELSE is_active END AS is_active, CASE WHEN action = 'lock' THEN 1 - coalesce(locked, 0) ELSE locked END AS locked
FROM e LEFT JOIN w USING (id) LEFT JOIN bad USING (id) WHERE action IS NULL OR action <> 'delete'""")
def f36b(spark, d):
    r, k = rules(spark, d), F.col("id")
    pattern = F.when(k % 11 == 4, F.concat(F.lit(" p"), ((k + 1) % 700).cast("string"))).otherwise(F.concat(F.lit("q"), k.cast("string"), F.lit(" ")))
    wanted = r.where("id % 11 in (4, 5)").select("id", "dimension", pattern.alias("pattern"), "label", "priority", "threshold")
    action = F.when(k % 7 == 0, "toggle").when(k % 7 == 1, "lock").when(k % 7 == 2, "delete")
    changed, _ = R.update_rules(r, wanted)
    return R.switch_edits(changed, r.select("id", action.alias("action")).where("action is not null")).select("id", "pattern", "is_active", "locked")
