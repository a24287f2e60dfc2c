"""Queries of retrieval (E): benchmark items ask, documents and embeddings answer."""

from pyspark.sql import functions as F

from clausespark.operators import retrieval as R
from clausespark.plans.data import table
from clausespark.plans.registry import query
from clausespark.tables import stored

#: Rows of the keyword arm that are fused, a fixed value.
KEYWORD_FETCH = 10_000
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
INDEX = f"""tokens AS (SELECT doc_id, 'body' AS field, unnest({TOK.format('text')}) AS token FROM documents UNION ALL SELECT doc_id, 'crumb', unnest({TOK.format("source || ' ' || lang")}) FROM documents),
postings AS (SELECT doc_id, field, token, count(*) AS tf FROM tokens GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf) AS len FROM postings GROUP BY 1),
terms AS (SELECT item_id AS query_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS term FROM (SELECT item_id, {TOK.format('text')} AS t FROM benchmark)),
asked AS (SELECT query_id, count(DISTINCT term) AS asked FROM terms GROUP BY 1)"""


def _scored(fields: str, weight: str) -> str:
    return f"""scoped AS (SELECT * FROM postings WHERE field IN ({fields})),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM scoped GROUP BY 1),
hit AS (SELECT query_id, term, token, doc_id, sum({weight} * tf) AS tf FROM scoped JOIN terms USING (token) GROUP BY ALL),
found AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score, count(DISTINCT term) AS matched
  FROM hit JOIN df USING (token) JOIN lens USING (doc_id), (SELECT count(*) AS docs, avg(len) AS avgdl FROM lens) GROUP BY ALL),
scored AS (SELECT * FROM found JOIN asked USING (query_id))"""


BOTH = _scored("'body', 'crumb'", "(CASE field WHEN 'body' THEN 1.0 ELSE 0.3 END)")
FALLBACK = "kept AS (SELECT * FROM (SELECT *, bool_or(matched = asked) OVER (PARTITION BY query_id) AS w FROM scored) WHERE matched = asked OR NOT w)"
VECTORS = """near AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))]), 6) AS distance
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near)"""


def _fields():
    return {"body": F.col("text"), "crumb": F.concat_ws(" ", "source", "lang")}


def _postings(spark, d):
    return R.inverted_index(table(spark, d, "documents"), _fields(), places=False)


#: Written indexes by session and folder: what searches read is written once and kept as long as the session's shared folder.
_WRITTEN: dict = {}


def _index(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        _WRITTEN[key] = R.write_index(table(spark, d, "documents"), _fields())
    return _WRITTEN[key]


def _terms(spark, d):
    return R.query_terms(table(spark, d, "benchmark"), "item_id", "text")


def _found(spark, d, crumb=0.3, scores=True):
    return R.matches(_index(spark, d), _terms(spark, d), {"body": 1.0, "crumb": crumb}, scores=scores)


def _best(spark, d, k):
    found = R.search(_index(spark, d), _terms(spark, d), {"body": 1.0, "crumb": 0.3}, k)
    return R.ranked(found, [F.desc("score"), "doc_id"], k)


def _nearest(spark, d, k):
    e = table(spark, d, "embeddings")
    return R.nearest(e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi"), e, k)


@query("e1_facets", "SELECT doc_id, source, lang FROM documents WHERE (contains(lang, 'en') OR contains(lang, 'r')) AND (contains(source, '1') OR contains(source, '7'))")
def e1(spark, d):
    any_of = lambda c, vs: F.exists(F.array(*map(F.lit, vs)), lambda v: F.contains(F.col(c), v))
    return table(spark, d, "documents").where(any_of("lang", ["en", "r"]) & any_of("source", ["1", "7"])).select("doc_id", "source", "lang")


@query("e2_status", "SELECT d.doc_id, d.lang, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang IN ('en', 'de') AND toxic = 0")
def e2(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").where(F.col("lang").isin("en", "de") & (F.col("toxic") == 0)).select("doc_id", "lang", "toxic")


@query("e3_replacing_spec", """WITH s AS (SELECT s_suppkey AS id, s_name AS code, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 END AS replaced_by FROM supplier)
SELECT l_orderkey, l_linenumber, s.code, r.code AS replaced_by_code FROM lineitem JOIN s ON l_suppkey = s.id LEFT JOIN s r ON r.id = s.replaced_by""")
def e3(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("spec_id"), F.col("s_name").alias("code"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") + 1).alias("replaced_by"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("spec_id"))
    return R.with_specs(lines, s).select("l_orderkey", "l_linenumber", "code", "replaced_by_code")


@query("e4_inverted_index", f"WITH {INDEX} SELECT doc_id, field, token, tf FROM postings")
def e4(spark, d):
    return _postings(spark, d).select("doc_id", "field", "token", "tf")


@query("e4_written_index", f"""WITH {INDEX}, t AS (SELECT doc_id, 'body' AS field, {TOK.format('text')} AS t FROM documents UNION ALL SELECT doc_id, 'crumb', {TOK.format("source || ' ' || lang")} FROM documents),
p AS (SELECT doc_id, field, unnest(t) AS token, 2 * (generate_subscripts(t, 1) - 1) AS place FROM t)
SELECT doc_id, field, token, count(*) AS tf, CAST(sum(place) AS BIGINT) AS places, CAST(any_value(len) AS BIGINT) AS len FROM p JOIN lens USING (doc_id) GROUP BY ALL""")
def e4c(spark, d):
    sum_ = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return _index(spark, d).postings().select("doc_id", "field", "token", "tf", sum_.alias("places"), "len")


#: Each letter a to z as an ideograph, so that words are runs of ideographs.
IDEOGRAPHS = "".join(chr(0x4E00 + 37 * i) for i in range(26))


@query("e5_phrases", f"""WITH d AS (SELECT doc_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{IDEOGRAPHS}') AS t FROM documents),
q AS (SELECT item_id AS query_id, 0 AS term, regexp_extract(lower(text), '^([a-z]*)', 1) AS w FROM benchmark UNION ALL SELECT item_id, 1, regexp_extract(lower(text), '([a-z]+)[^a-z]*$', 1) FROM benchmark),
x AS (SELECT query_id, term, translate(w, 'abcdefghijklmnopqrstuvwxyz', '{IDEOGRAPHS}') AS w FROM q WHERE w <> ''),
m AS (SELECT query_id, term, doc_id, CAST(len(string_split(t, w)) - 1 AS BIGINT) AS n FROM x JOIN d ON contains(t, w) WHERE length(w) > 1)
SELECT query_id, doc_id, count(DISTINCT term) AS terms FROM m GROUP BY ALL""")
def e5b(spark, d):
    """Documents and questions of which words are runs of ideographs: the first and the last word of each item, as phrases."""
    ideographs = lambda c: F.translate(F.lower(c), "abcdefghijklmnopqrstuvwxyz", IDEOGRAPHS)
    docs = table(spark, d, "documents").select("doc_id", ideographs(F.col("text")).alias("text"))
    words = F.concat_ws(" ", F.regexp_extract(F.lower("text"), "^([a-z]*)", 1), F.regexp_extract(F.lower("text"), "([a-z]+)[^a-z]*$", 1))
    asked = table(spark, d, "benchmark").select("item_id", ideographs(words).alias("text"))
    terms = R.query_terms(asked, "item_id", "text").where("steps > 1 OR length(token) > 1")
    return R.matches(R.index_of(docs, {"body": F.col("text")}), terms, {"body": 1.0}, scores=False).select("query_id", "doc_id", F.col("matched").alias("terms"))


@query("e4_term_statistics", f"WITH {INDEX} SELECT token, count(DISTINCT doc_id) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY token")
def e4b(spark, d):
    rows = _postings(spark, d).groupBy("doc_id", "token").agg(F.sum("tf").alias("tf"))  # where the row's postings are
    return rows.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("e5_all_terms", f"WITH {INDEX} SELECT query_id, doc_id FROM postings JOIN terms USING (token) JOIN asked USING (query_id) GROUP BY query_id, doc_id, asked HAVING count(DISTINCT term) = asked")
def e5(spark, d):
    return _found(spark, d, scores=False).where("matched = asked").select("query_id", "doc_id")


@query("e6_or_fallback", f"WITH {INDEX}, {BOTH}, {FALLBACK} SELECT query_id, count(*) AS n, min(matched) AS least_matched FROM kept GROUP BY query_id")
def e6(spark, d):
    return R.with_fallback(_found(spark, d, scores=False)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("matched").alias("least_matched"))


@query("e7_body_only", f"WITH {INDEX}, {_scored(repr('body'), '1.0')} SELECT query_id, doc_id, matched FROM scored")
def e7(spark, d):
    return _found(spark, d, 0.0, scores=False).select("query_id", "doc_id", "matched")


@query("e8_bm25", f"WITH {INDEX}, {BOTH}, {FALLBACK} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM kept QUALIFY rank <= 20")
def e8(spark, d):
    return _best(spark, d, 20).select("query_id", "doc_id", "score", "rank")


TIER = "CASE WHEN CAST(doc_id AS VARCHAR) = token THEN 0 WHEN contains(CAST(doc_id AS VARCHAR), token) THEN 1 WHEN contains(source || ' ' || lang, token) THEN 2 ELSE 3 END"


@query("e9_field_tiers", f"""WITH {INDEX}, {BOTH}, {FALLBACK}, first AS (SELECT query_id, token FROM terms WHERE term = 0),
t AS (SELECT k.query_id, k.doc_id, {TIER} AS tier, score FROM kept k JOIN first USING (query_id) JOIN documents USING (doc_id))
SELECT query_id, doc_id, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, doc_id) AS INTEGER) AS rank FROM t QUALIFY rank <= 20""")
def e9(spark, d):
    first = _terms(spark, d).where("term = 0").select("query_id", "token")
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("title"))
    no = F.col("doc_id").cast("string")
    tier = F.when(no == F.col("token"), 0).when(F.contains(no, F.col("token")), 1).when(F.contains("title", F.col("token")), 2).otherwise(3)
    found = R.search(_index(spark, d), _terms(spark, d), {"body": 1.0, "crumb": 0.3}, 20, also=docs, cut=False)
    # of the last tier no more than the 20 best by score can be among the first 20
    t = found.join(first, "query_id").withColumn("tier", tier).where("tier < 3 OR near")
    return R.ranked(t, ["tier", F.desc("score"), "doc_id"], 20).select("query_id", "doc_id", "tier", "rank")


@query("e10_page", f"""WITH {INDEX}, {BOTH}, {FALLBACK} SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS total, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM kept QUALIFY rank BETWEEN 11 AND 20""")
def e10(spark, d):
    return _best(spark, d, 20).where("rank > 10").select("query_id", "doc_id", "total", "rank")


@query("e11_nearest", f"WITH {VECTORS} SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM nearest WHERE rank <= 10")
def e11(spark, d):
    return _nearest(spark, d, 10).select("query_id", "vec_id", "distance", "rank")


@query("e12_cap_per_group", f"""WITH {VECTORS}, g AS (SELECT n.query_id, n.vec_id, label, distance, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS i FROM nearest n JOIN embeddings USING (vec_id) WHERE rank <= 100)
SELECT query_id, vec_id, label, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM g WHERE i <= 2 QUALIFY rank <= 10""")
def e12(spark, d):
    found = _nearest(spark, d, 100).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return R.cap_per_group(found, "label", 2, 10).select("query_id", "vec_id", "label", "rank")


@query("e13_encode", "SELECT doc_id, CAST(64 AS INTEGER) AS dims, 1.0::DOUBLE AS norm FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')")
def e13(spark, d):
    from clausespark.operators.encoders import hashed_vectors

    v = hashed_vectors(table(spark, d, "documents"), "doc_id", "text", 64).where(F.exists("embedding", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("doc_id", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"))


@query("e13_token_weights", f"WITH t AS (SELECT DISTINCT doc_id, unnest({TOK.format('text')}) AS token FROM documents) SELECT token, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)), 9) AS weight FROM t GROUP BY token")
def e13b(spark, d):
    from clausespark.operators.encoders import token_weights

    return token_weights(table(spark, d, "documents"), "doc_id", "text").select("token", F.round("weight", 9).alias("weight"))


@query("e13_weighted_terms", f"""WITH t AS (SELECT doc_id, unnest({TOK.format('text')}) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents), w AS (SELECT token, ln((any_value(n) + 1) / (count(DISTINCT doc_id) + 1)) AS w FROM t, n GROUP BY token)
SELECT doc_id, round(sum(w * w), 4) AS squares FROM (SELECT doc_id, token, sum(w) AS w FROM t JOIN w USING (token) GROUP BY ALL) GROUP BY doc_id HAVING sum(w * w) > 0""")
def e13c(spark, d):
    """Squared length of every document's weighted counts; each token has a slot of its own, as each row is a text of one token."""
    from clausespark.operators.encoders import hashed_vectors, token_weights

    docs = table(spark, d, "documents")
    weights = stored(token_weights(docs, "doc_id", "text"), "token-weights")
    each = R.inverted_index(docs, {"body": F.col("text")}, places=False).select("doc_id", "token", F.col("tf").alias("n"))
    lengths = each.join(weights, "token").groupBy("doc_id").agg(F.round(F.sum((F.col("n") * F.col("weight")) ** 2), 4).alias("squares"))
    lengths = stored(lengths.where("squares > 0"), "squares")  # shuffle files of tokens go before the vectors' begin
    had = hashed_vectors(docs, "doc_id", "text", 64, weights).where(F.exists("embedding", lambda x: x != 0)).select("doc_id")
    return lengths.join(had, "doc_id", "left_semi")


@query("e14_best_chunk", f"""WITH {VECTORS}, b AS (SELECT query_id, label, min(distance) AS distance FROM nearest JOIN embeddings USING (vec_id) WHERE rank <= 100 AND distance < 1.9 GROUP BY ALL)
SELECT query_id, label, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, label) AS INTEGER) AS rank FROM b""")
def e14(spark, d):
    found = _nearest(spark, d, 100).where("distance < 1.9").join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    best = found.groupBy("query_id", "label").agg(F.min("distance").alias("distance"))
    return R.ranked(best, ["distance", "label"], 1 << 30).select("query_id", "label", "distance", "rank")


FUSED = f"""WITH {INDEX}, {BOTH}, {FALLBACK}, {VECTORS},
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS kr FROM kept QUALIFY kr <= 10000),
b AS (SELECT query_id, vec_id AS doc_id, rank AS vr FROM nearest WHERE rank <= 100 AND distance < 2.0),
f AS (SELECT query_id, doc_id, kr, vr, round(coalesce(1 / (60.0 + kr), 0) + coalesce(1 / (60.0 + vr), 0), 9) AS score, CASE WHEN kr IS NOT NULL AND vr IS NOT NULL THEN 'hybrid' WHEN kr IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS tag FROM a FULL JOIN b USING (query_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kr NULLS LAST, vr NULLS LAST, doc_id) AS rank FROM f)"""


def _fused(spark, d):
    a = _best(spark, d, KEYWORD_FETCH)
    b = _nearest(spark, d, 100).where("distance < 2.0").withColumnRenamed("vec_id", "doc_id")
    return R.fuse(a, b)


@query("e15_fusion", FUSED + " SELECT query_id, doc_id, score, tag, CAST(rank AS INTEGER) AS rank FROM r")
def e15(spark, d):
    return _fused(spark, d).select("query_id", "doc_id", "score", "tag", "rank")


@query("e16_rerank_head", FUSED + """, l AS (SELECT r.query_id, r.doc_id, r.rank, n_chars FROM r JOIN documents USING (doc_id)), m AS (SELECT *, count(*) OVER (PARTITION BY query_id) > 1 AND rank <= 20 AS h FROM l)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN h THEN 0 ELSE 1 END, CASE WHEN h THEN -n_chars END, rank) AS INTEGER) AS final_rank FROM m""")
def e16(spark, d):
    return R.rerank_head(_fused(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"), "n_chars").select("query_id", "doc_id", "final_rank")


DOT = "round(list_sum([x[1] * x[2] FOR x IN list_zip(CAST(qe.embedding AS DOUBLE[]), CAST(de.embedding AS DOUBLE[]))]), 6)"


@query("e17_rerank_dot", FUSED + f"""SELECT r.query_id, r.doc_id, CASE WHEN de.vec_id IS NULL THEN 'none' ELSE 'vector' END AS level, CASE WHEN de.vec_id IS NULL THEN 1.0 ELSE {DOT} END AS rerank_score
FROM r LEFT JOIN embeddings qe ON qe.vec_id = r.query_id LEFT JOIN embeddings de ON de.vec_id = r.doc_id WHERE r.rank <= 20""")
def e17(spark, d):
    e = table(spark, d, "embeddings")
    f = _fused(spark, d).where("rank <= 20").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")), "query_id", "left").join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v")), "doc_id", "left")
    return R.rerank(f).select("query_id", "doc_id", "level", "rerank_score")


@query("e17_rerank_pairs", FUSED + " SELECT r.query_id, r.doc_id, CASE WHEN d.lang = 'fr' THEN 'none' ELSE 'cross' END AS level, CASE WHEN d.lang = 'fr' THEN 1.0 ELSE length(b.text[1:300]) + length(d.source) END AS rerank_score FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d USING (doc_id) WHERE r.rank <= 20")
def e17b(spark, d):
    f = _fused(spark, d).where("rank <= 20").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question_text")), "query_id")
    passage = F.concat("source", F.when(F.col("lang") == "fr", "!").otherwise(""))
    f = f.join(table(spark, d, "documents").select("doc_id", passage.alias("passage_text")), "doc_id").withColumns({"q": F.lit(None).cast("array<double>"), "v": F.lit(None).cast("array<double>")})
    by_length = lambda x, y: [float("nan") if b.endswith("!") else len(a) + len(b) for a, b in zip(x, y, strict=True)]
    return R.rerank(f, "passage_text", "question_text", by_length).select("query_id", "doc_id", "level", "rerank_score")


@query("e18_hybrid_search", FUSED + """SELECT r.query_id, r.doc_id, r.score, r.tag, CAST(r.rank AS INTEGER) AS rank, d.source, d.lang FROM r JOIN documents d USING (doc_id) WHERE r.rank <= 20""")
def e18(spark, d):
    top = _fused(spark, d).where("rank <= 20")
    return top.join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").select("query_id", "doc_id", "score", "tag", "rank", "source", "lang")


@query("e19_facet_tree", """WITH v AS (SELECT 'p_brand' AS dim, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type || ', ' || p_brand FROM part),
c AS (SELECT dim, value, count(*) AS n FROM v WHERE value <> '' GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 30)
SELECT dim, trim(unnest(string_split(value, ','))) AS value, n, rank FROM r""")
def e19(spark, d):
    return R.facet_tree(table(spark, d, "part").select("p_brand", F.concat_ws(", ", "p_type", "p_brand").alias("p_type")), ["p_brand", "p_type"])


@query("e20_duplicate_specs", r"""WITH s AS (SELECT s_suppkey AS id, 'GBT' || s_suppkey % 40 AS code, regexp_replace(lower('t ' || s_suppkey % 30), '\s+', '', 'g') AS title FROM supplier)
SELECT a.id, b.id AS other, CASE WHEN a.code = b.code AND a.title = b.title THEN 'code+title' WHEN a.code = b.code THEN 'code' ELSE 'title' END AS reasons FROM s a JOIN s b ON a.id <> b.id AND (a.code = b.code OR a.title = b.title)""")
def e20(spark, d):
    s = _specs(spark, d)
    return R.likely_copies(s, s, "s_suppkey", "code", "title")


def _specs(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("GB/T "), (F.col("s_suppkey") % 40).cast("string")).alias("code"), F.concat(F.lit("T  "), (F.col("s_suppkey") % 30).cast("string")).alias("title"))


@query("e20_duplicate_groups", """WITH s AS (SELECT s_suppkey AS id, unnest(['code', 'title']) AS reason, unnest(['GBT' || s_suppkey % 40, 't' || s_suppkey % 30]) AS k FROM supplier)
SELECT id, reason, min(id) OVER (PARTITION BY reason, k) AS first, count(*) OVER (PARTITION BY reason, k) AS rows FROM s QUALIFY rows > 1""")
def e20b(spark, d):
    return R.suspected_duplicates(_specs(spark, d), "s_suppkey", "code", "title")
