"""Queries of the lexicon (D): rows from part, texts from documents."""

from pyspark.sql import functions as F

from clausespark.operators import lexicon as L
from clausespark.plans.data import sql_values, table, values
from clausespark.plans.registry import query
from clausespark.plans.retrieval_queries import TOK

LEX = """lex AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'alias' WHEN 1 THEN 'confusable' ELSE 'synonym' END AS kind, 'w' || p_partkey AS canonical,
CASE WHEN p_partkey % 7 = 0 THEN 'w' || (p_partkey + 3) || ',v' || p_partkey ELSE 'v' || p_partkey || ', u' || p_partkey // 40 * CASE WHEN p_partkey % 40 < 2 THEN 1 ELSE p_partkey END END AS variants,
'' AS distinguish, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS is_active FROM part),
words AS (SELECT DISTINCT id, kind, is_active, trim(unnest([canonical] || string_split(variants, ','))) AS word FROM lex),
eq AS (SELECT * FROM words WHERE kind <> 'confusable')"""
TERMS = [(1, "alias", "the", "die,les", "", 1), (2, "synonym", "and", "und,et", "", 1), (3, "confusable", "der", "den,das", "x", 1), (4, "confusable", "que", "qui,quo", "x", 1)]
SCHEMA = "id long, kind string, canonical string, variants string, distinguish string, is_active int"


def lexicon(spark, d):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    u = F.expr("p_partkey div 40") * F.when(k % 40 < 2, 1).otherwise(k)
    variants = F.when(k % 7 == 0, F.concat(F.lit("w"), s(k + 3), F.lit(",v"), s(k))).otherwise(F.concat(F.lit("v"), s(k), F.lit(", u"), s(u)))
    return table(spark, d, "part").select(k.alias("id"), F.when(k % 5 == 0, "alias").when(k % 5 == 1, "confusable").otherwise("synonym").alias("kind"), F.concat(F.lit("w"), s(k)).alias("canonical"), variants.alias("variants"), F.lit("").alias("distinguish"), F.when(k % 11 == 0, 0).otherwise(1).alias("is_active"))


def terms(spark):
    return values(spark, TERMS, SCHEMA)


@query("d1_active_groups", f"WITH {LEX}, bad AS (SELECT word FROM eq WHERE is_active = 1 GROUP BY word HAVING count(DISTINCT id) > 1) SELECT id, kind FROM lex WHERE is_active = 1 AND id NOT IN (SELECT id FROM eq WHERE is_active = 1 AND word IN (SELECT word FROM bad))")
def d1(spark, d):
    return L.active_groups(lexicon(spark, d)).select("id", "kind")


@query("d2_first_conflict", f"WITH {LEX}, w AS (SELECT id AS request, id AS exclude, word FROM words) SELECT request, min(w.word) AS word FROM w JOIN eq ON eq.word = w.word AND eq.id <> exclude GROUP BY request")
def d2(spark, d):
    rows = lexicon(spark, d)
    return L.first_conflict(rows, L.words(rows).select(F.col("id").alias("request"), F.col("id").alias("exclude"), "word"))


CLUSTER = LEX + """, shared AS (SELECT word FROM eq GROUP BY word HAVING count(DISTINCT id) > 1), m AS (SELECT id, word FROM eq WHERE word IN (SELECT word FROM shared)), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM m a JOIN m b USING (word)),
reach AS (SELECT a AS id, b AS r FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a), cl AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"""


@query("d3_clusters", f"WITH RECURSIVE {CLUSTER} SELECT id, cluster FROM cl")
def d3(spark, d):
    return L.clusters(lexicon(spark, d))


ACTION = CLUSTER + """, sets AS (SELECT lex.id, kind, canonical, cluster, list_sort(list_distinct([trim(x) FOR x IN [canonical] || string_split(variants, ',')])) AS s FROM lex JOIN cl USING (id)),
chain AS (SELECT DISTINCT a.cluster FROM sets a JOIN sets b ON a.cluster = b.cluster AND a.id <> b.id AND list_contains(b.s, a.canonical)),
act AS (SELECT cluster, CASE WHEN count(*) > 2 THEN 'BIG' WHEN count(DISTINCT s) = 1 THEN 'SAME_SET' WHEN cluster IN (SELECT cluster FROM chain) THEN 'CHAIN' ELSE 'AMBIGUOUS' END AS type, arg_min(id, (kind <> 'alias', id)) AS keeper,
array_to_string(list_sort([x FOR x IN list_distinct(flatten(list(s))) IF x <> arg_min(canonical, (kind <> 'alias', id))]), ',') AS variants FROM sets GROUP BY cluster)"""


@query("d4_cluster_actions", f"WITH RECURSIVE {ACTION} SELECT cluster, type, keeper, variants FROM act")
def d4(spark, d):
    rows = lexicon(spark, d)
    return L.cluster_actions(rows, L.clusters(rows))


@query("d5_resolve", f"WITH RECURSIVE {ACTION} SELECT lex.id, lex.kind, coalesce(act.variants, lex.variants) AS variants FROM lex LEFT JOIN cl USING (id) LEFT JOIN act USING (cluster) WHERE keeper IS NULL OR keeper = lex.id")
def d5(spark, d):
    rows = lexicon(spark, d)
    found = L.clusters(rows)
    return L.resolve_clusters(rows, L.cluster_actions(rows, found), found).select("id", "kind", "variants")


D6 = "SELECT doc_id, replace(replace(replace(replace(text, 'die', 'the'), 'les', 'the'), 'und', 'and'), 'et', 'and') AS normalized FROM documents"


@query("d6_normalize", D6)
def d6(spark, d):
    return L.normalize_text(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", terms(spark)).select("doc_id", "normalized")


@query("d6_normalize_rounds", D6)
def d6b(spark, d):
    """As for a lexicon of any size."""
    return L.normalize_text(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", terms(spark), fold=0).select("doc_id", "normalized")


D7 = r"""WITH s AS (SELECT item_id AS query_id, regexp_split_to_array(trim(text), 'and|die|les|the|und|et') AS b, regexp_extract_all(trim(text), 'and|die|les|the|und|et') || [''] AS h FROM benchmark),
g(w, t) AS (VALUES ('the', ['the', 'die', 'les']), ('die', ['the', 'die', 'les']), ('les', ['the', 'die', 'les']), ('and', ['and', 'und', 'et']), ('und', ['and', 'und', 'et']), ('et', ['and', 'und', 'et'])),
i AS (SELECT query_id, unnest(b) AS b, unnest(h) AS h, generate_subscripts(b, 1) AS k FROM s),
w AS (SELECT query_id, k, generate_subscripts(x, 1) AS j, [unnest(x)] AS words FROM (SELECT query_id, k, regexp_extract_all(lower(b), '[\p{L}\p{N}]+') AS x FROM i) UNION ALL SELECT query_id, k, 1000000, t FROM i JOIN g ON h = w),
p AS (SELECT query_id, words, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, j) - 1 AS INTEGER) AS position FROM w)"""


@query("d7_expand_queries", D7 + " SELECT query_id, position, unnest(words) AS term FROM p")
def d7(spark, d):
    return L.expand_queries(_asked(spark, d), "text", terms(spark).where("kind <> 'confusable'"))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


for _join in ("AND", "OR"):

    @query(f"d7_match_{_join.lower()}", D7 + f""" SELECT query_id, string_agg(CASE WHEN len(words) = 1 THEN '"' || words[1] || '"' ELSE '("' || array_to_string(words, '" OR "') || '")' END, ' {_join} ' ORDER BY position) AS expression FROM p GROUP BY query_id""")
    def d7b(spark, d, join=_join):
        return L.match_expressions(_asked(spark, d), "text", terms(spark).where("kind <> 'confusable'"), join)


@query("d8_confusable", f"""WITH p(pair, canonical, pos, variant) AS (VALUES (3, 'der', 0, 'den'), (3, 'der', 1, 'das'), (4, 'que', 0, 'qui'), (4, 'que', 1, 'quo'))
SELECT doc_id, pair, canonical, arg_min(variant, pos) AS variant FROM documents JOIN p ON contains(text, canonical) AND contains(text, variant) GROUP BY ALL""")
def d8(spark, d):
    return L.confusable_hits(table(spark, d, "documents"), "doc_id", "text", terms(spark))


@query("d9_validate", """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'kind' WHEN p_partkey % 6 = 1 THEN 'canonical' WHEN p_partkey % 6 = 2 THEN 'one variant' WHEN p_partkey % 6 = 3 THEN 'explanation' WHEN p_partkey % 6 = 4 THEN 'overlap' END AS error FROM part""")
def d9(spark, d):
    m = F.col("p_partkey") % 6
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(m == 0, "other").when(m.isin(2, 3), "confusable").otherwise("alias").alias("kind"), F.when(m == 1, " ").otherwise(F.col("p_brand")).alias("canonical"),
        F.when(m == 2, "a,b").when(m == 4, F.concat("p_brand", F.lit("x"))).otherwise("zz").alias("variants"), F.lit("").alias("distinguish"),
    )
    return rows.select("id", L.validation_error().alias("error"))


@query("d10_upsert", "SELECT 'fail' AS result, count(*) AS n FROM supplier WHERE s_suppkey % 4 = 3 UNION ALL SELECT 'ok', count(DISTINCT s_suppkey % 4 || '/' || s_suppkey // 8) FROM supplier WHERE s_suppkey % 4 < 3 UNION ALL SELECT 'skip', count(*) - count(DISTINCT s_suppkey % 4 || '/' || s_suppkey // 8) FROM supplier WHERE s_suppkey % 4 < 3")
def d10(spark, d):
    k = F.col("s_suppkey")
    key = F.concat_ws("_", (k % 4).cast("string"), F.expr("s_suppkey div 8").cast("string"))
    new = table(spark, d, "supplier").select(k.alias("line"), F.when(k % 4 == 3, "?").otherwise("alias").alias("kind"), F.concat(F.lit("n"), key).alias("canonical"), F.concat(F.lit("m"), key).alias("variants"), F.lit("").alias("distinguish"))
    return L.upsert(lexicon(spark, d), new)[1]


@query("d11_migrate_synonyms", "SELECT p_brand AS target, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS variants, max(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS is_active FROM part GROUP BY p_brand")
def d11(spark, d):
    return L.migrate_synonyms(table(spark, d, "part").select(F.col("p_brand").alias("target"), F.col("p_type").alias("source"), F.when(F.col("p_size") > 25, 1).otherwise(0).alias("is_active")))


@query("d12_recall_difference", f"""WITH a AS (SELECT DISTINCT t AS term, doc_id AS id FROM (SELECT doc_id, unnest({TOK.format('text')}) AS t FROM documents)), q AS (SELECT DISTINCT unnest({TOK.format('text')}) AS term FROM benchmark), x AS (SELECT * FROM a WHERE term IN (SELECT term FROM q)),
y AS (SELECT term, id FROM (SELECT DISTINCT t AS term, doc_id AS id FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents)) WHERE term IN (SELECT term FROM q))
SELECT term, count(x.id) AS before, count(*) FILTER (y.id IS NULL) AS lost, count(*) FILTER (x.id IS NULL) AS gained FROM (SELECT term, id FROM x) x FULL JOIN (SELECT term, id FROM y) y USING (term, id) GROUP BY term""")
def d12(spark, d):
    from clausespark.functions.text import tokenize

    docs = table(spark, d, "documents")
    asked = table(spark, d, "benchmark").select(F.explode(tokenize("text")).alias("term")).distinct()
    hits = lambda t: docs.select(F.explode(t).alias("term"), F.col("doc_id").alias("id")).join(asked, "term", "left_semi")
    return L.recall_difference(hits(tokenize("text")), hits(F.split(F.lower("text"), " ", -1)))


@query("d13_edit", f"WITH {LEX} SELECT id, CASE WHEN id % 3 = 0 THEN 1 - is_active ELSE is_active END AS is_active FROM lex WHERE id % 5 <> 4 OR id % 3 = 0")
def d13(spark, d):
    rows = lexicon(spark, d)
    edits = rows.select("id", F.when(F.col("id") % 3 == 0, "toggle").when(F.col("id") % 5 == 4, "delete").alias("action")).where("action is not null")
    return L.edit(rows, edits).select("id", "is_active")


@query("d5_decided", """WITH b AS (SELECT p_partkey // 4 AS g, p_partkey AS id FROM part), m AS (SELECT g, min(id) AS k, max(id) AS z FROM b GROUP BY g HAVING count(*) = 4)
SELECT k AS id, 's' || g AS canonical, 'w' || k || ',w' || k + 1 || ',w' || k + 2 || ',w' || z AS variants FROM m WHERE g % 4 = 0
UNION ALL SELECT id, CASE WHEN id = k THEN 'w' || k ELSE 'w' || id || 'x' END, CASE WHEN id = k THEN 's' || g ELSE 'y' || g END FROM m JOIN b USING (g) WHERE g % 4 = 1 AND id <= k + 1
UNION ALL SELECT id, 'w' || id, 's' || g FROM m JOIN b USING (g) WHERE g % 4 = 2 AND id <> k + 1
UNION ALL SELECT k, 'w' || k, 's' || g || ',w' || k + 1 || ',w' || k + 2 || ',w' || z FROM m WHERE g % 4 = 3""")
def d5b(spark, d):
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    p = table(spark, d, "part").select(k.alias("id"), F.expr("p_partkey div 4").alias("g"))
    m = p.groupBy("g").agg(F.min("id").alias("k"), F.count("*").alias("n")).where("n = 4")
    rows = p.join(m, "g").select("id", F.lit("synonym").alias("kind"), F.concat(F.lit("w"), s(F.col("id"))).alias("canonical"), F.concat(F.lit("s"), s(F.col("g"))).alias("variants"), F.lit("").alias("distinguish"), F.lit(1).alias("is_active"))
    w = lambda x: F.concat(F.lit("w"), s(x))
    parts = F.array(F.struct(w(F.col("k")).alias("canonical"), F.concat(F.lit("s"), s(F.col("g"))).alias("variants")), F.struct(F.concat(w(F.col("k") + 1), F.lit("x")).alias("canonical"), F.concat(F.lit("y"), s(F.col("g"))).alias("variants")))
    action = F.when(F.col("g") % 4 == 0, "merge").when(F.col("g") % 4 == 1, "split").otherwise("drop")
    canonical = F.when(F.col("g") % 4 == 0, F.concat(F.lit("s"), s(F.col("g")))).when(F.col("g") % 4 == 2, w(F.col("k") + 1))
    decisions = m.where("g % 4 <> 3").select(F.concat(F.lit("s"), s(F.col("g"))).alias("word"), action.alias("action"), canonical.alias("canonical"), parts.alias("groups"))
    return L.resolve_decided(rows, L.clusters(rows), decisions).select("id", "canonical", "variants")


@query("d13_change", """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'confusable' ELSE 'synonym' END AS kind, 'w' || p_partkey AS canonical, 'v' || p_partkey AS variants, 'd' AS distinguish FROM part),
w AS (SELECT id AS request, CASE WHEN id % 2 = 0 THEN id END AS id, kind, CASE WHEN id % 4 = 1 THEN 'n' || id ELSE canonical END AS canonical, CASE WHEN id % 8 = 4 THEN 'v' || id + 1 WHEN id % 4 = 1 THEN 'm' || id ELSE variants END AS variants, CASE WHEN id % 10 = 0 THEN '' ELSE 'd' END AS distinguish FROM r),
e AS (SELECT w.*, CASE WHEN kind = 'confusable' AND distinguish = '' THEN 'explanation' WHEN kind = 'synonym' AND w.id IS NULL AND EXISTS (SELECT 1 FROM r WHERE r.kind = w.kind AND r.canonical = w.canonical) THEN 'canonical taken'
WHEN kind = 'synonym' THEN (SELECT 'word taken: ' || min(x) FROM r JOIN (VALUES (w.canonical), (w.variants)) t(x) ON r.kind = 'synonym' AND (r.canonical = x OR r.variants = x) WHERE w.id IS NULL OR r.id <> w.id) END AS error FROM w)
SELECT request, error FROM e WHERE error IS NOT NULL""")
def d13b(spark, d):
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    p = table(spark, d, "part")
    kind = F.when(k % 3 == 0, "confusable").otherwise("synonym").alias("kind")
    named = lambda x, c=k: F.concat(F.lit(x), s(c))
    rows = p.select(k.alias("id"), kind, named("w").alias("canonical"), named("v").alias("variants"), F.lit("d").alias("distinguish"), F.lit(1).alias("is_active"))
    variants = F.when(k % 8 == 4, named("v", k + 1)).when(k % 4 == 1, named("m")).otherwise(named("v"))
    wanted = p.select(k.alias("request"), F.when(k % 2 == 0, k).alias("id"), kind, F.when(k % 4 == 1, named("n")).otherwise(named("w")).alias("canonical"), variants.alias("variants"), F.when(k % 10 == 0, "").otherwise("d").alias("distinguish"))
    return L.change(rows, wanted)[1]
