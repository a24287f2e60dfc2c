"""Queries of document structuring (B4, C): documents whose lines are numbered like a standard's."""

from pyspark.sql import functions as F

from clausespark.operators import structure as S
from clausespark.plans.data import table
from clausespark.plans.registry import query

LETTER = r"\p{L}"


def md_lines(spark, d, contents=False):
    """Whole documents as numbered lines: chapters, clauses, body lines, titles of notes and headings out of order.

    A heading takes the beginning of its line, the rest is the body line behind it. A quarter of the documents begin
    with two lines before any heading. Before and behind, documents have what FRONT and BACK add: prefaces, page marks, stray
    numbers, groups of labels, appendices, letter numbers, notes on wording, commentary and contents pages.
    """
    docs = table(spark, d, "documents").withColumn("last", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)) - 1)
    t = docs.select("doc_id", "last", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    k, s, m = F.col("line"), F.trim("text"), F.col("line") % 6
    no = F.expr("line div 6 + 1").cast("string")
    bare = (F.col("doc_id") % 4 == 0) & (k < 2)
    note = k % 36 == 18
    cut = F.when(bare, None).when(note, 0).when(m == 0, 15).when(m == 1, 30).when(m == 3, 12).when(k % 12 == 5, 10)
    title = F.trim(F.substring(s, F.lit(1), F.coalesce(F.col("cut"), F.lit(0))))
    text = (
        F.when(bare, s).when(note, F.concat(F.lit("# "), no, F.lit(" 本规范用词说明"))).when(m == 0, F.concat(F.lit("# "), no, F.lit(" "), title)).when(m == 1, F.concat(no, F.lit(".1 "), title))
        .when(m == 3, F.concat(no, F.lit(".2 "), title)).when(m == 4, F.concat(no, F.lit(".2.1 "), s)).when(m == 2, "## Contents" if contents else s).when(k % 12 == 5, F.concat(F.lit("# 1 "), title)).otherwise(s)
    )
    rest = F.when(F.col("cut").isNotNull(), F.trim(F.substring(s, F.col("cut") + 1, F.length(s))))
    both = F.filter(F.array(F.struct((k * 2).alias("line"), F.trim(text).alias("text")), F.struct((k * 2 + 1).alias("line"), rest.alias("text"))), lambda x: (x["line"] % 2 == 0) | (x["text"] != ""))
    none = F.array().cast("array<struct<line:int,text:string>>")

    def added(rows):
        return F.filter(F.array(*[F.struct(F.lit(i).alias("line"), F.when(F.expr(when), F.trim(F.expr(what))).alias("text")) for i, when, what in rows]), lambda x: x["text"].isNotNull())

    parts = F.concat(F.when(k == 0, added(FRONT)).otherwise(none), both, F.when(k == F.col("last"), added(BACK)).otherwise(none))
    rows = t.withColumns({"cut": cut, "s": s}).select("doc_id", F.explode(parts).alias("l"))
    return rows.select("doc_id", "l.line", "l.text")


#: Lines before the first and behind the last one: their place, the documents that have them, and the text, s being the first or last line.
FRONT = [
    (-9, "doc_id % 3 = 0", "'# 前言'"), (-8, "doc_id % 3 = 0", "s"), (-7, "doc_id % 3 = 0", "'## 第 ' || (doc_id % 9 + 1) || ' 页'"), (-6, "doc_id % 3 = 0 AND doc_id % 2 = 0", "s"),
    (-5, "doc_id % 3 = 1 AND doc_id % 4 = 1", "'1'"), (-4, "doc_id % 3 = 1 AND doc_id % 4 = 1", "s"), (-3, "doc_id % 3 = 2 AND doc_id % 4 = 2", "'目次'"), (-2, "doc_id % 3 = 2 AND doc_id % 4 = 2", "s"),
]
_B = 1_000_000
BACK = [
    (_B, "doc_id % 2 = 0", "'# 90 附则'"), (_B + 1, "doc_id % 2 = 0", "'## 90.4 检验标准'"), (_B + 2, "doc_id % 2 = 0", "'主控项目'"), (_B + 3, "doc_id % 4 = 0", "'Ⅱ 一般项目'"), (_B + 4, "doc_id % 6 = 0", "s"),
    (_B + 5, "doc_id % 2 = 0", "'## 附录 A ' || substr(s, 1, 12)"), (_B + 6, "doc_id % 2 = 0", "'A. 1.2 ' || s"), (_B + 7, "doc_id % 2 = 0", "'A.1.3 ' || substr(s, 1, 12)"), (_B + 8, "doc_id % 2 = 0", "'#### B.0.1'"), (_B + 9, "doc_id % 2 = 0", "s"),
    (_B + 10, "doc_id % 2 = 0", "'# 91 本规范用词说明'"), (_B + 11, "doc_id % 2 = 0", "'91.0.1 ' || s"), (_B + 12, "doc_id % 2 = 0", "'91.0.1 条第二款的规定'"), (_B + 13, "doc_id % 2 = 0", "'91.0.2'"), (_B + 14, "doc_id % 2 = 0", "s"),
    (_B + 20, "doc_id % 5 = 0", "'条文说明'"), (_B + 21, "doc_id % 5 = 1", "'附：条文说明'"), (_B + 22, "doc_id % 5 < 2", "'# 1 总则'"), (_B + 23, "doc_id % 5 < 2", "'1.0.1 ' || s"), (_B + 24, "doc_id % 5 < 2", "'1.0.1 ' || substr(s, 1, 12)"),
    (_B + 25, "doc_id % 5 < 2", "'# 2023'"), (_B + 26, "doc_id % 5 < 2", "'## 2.0 条文'"), (_B + 27, "doc_id % 5 < 2", "'# 3 允许偏差应符合规定。'"), (_B + 28, "doc_id % 5 = 2", "'# 条文说明'"), (_B + 29, "doc_id % 5 = 2", "'1.1 ' || s"),
    (_B + 30, "doc_id % 7 = 3", "'## Contents'"), (_B + 31, "doc_id % 7 = 3", "s"), (_B + 32, "doc_id % 7 = 3", "'## 95.1 目  次'"), (_B + 33, "doc_id % 7 = 3", "s"), (_B + 34, "doc_id % 7 = 3", "'# 96 ' || substr(s, 1, 12)"), (_B + 35, "doc_id % 7 = 3", "s"),
    (_B + 40, "doc_id % 7 = 4", "'2020-04-23 发布'"), (_B + 41, "doc_id % 7 = 4", "'97.1 总则.........12'"), (_B + 42, "doc_id % 7 = 4", "'0.95 系数'"), (_B + 43, "doc_id % 7 = 4", "'98.0 占位'"), (_B + 44, "doc_id % 7 = 4", "'7 钢筋'"), (_B + 45, "doc_id % 7 = 4", "'98.3．2 ' || s"),
]


def _added_sql(rows, at):
    parts = ", ".join(f"{{'line': {i}, 'text': CASE WHEN {when} THEN trim({what}) END}}" for i, when, what in rows)
    return f"SELECT doc_id, x.line AS line, x.text AS text FROM (SELECT doc_id, unnest([{parts}]) AS x FROM (SELECT doc_id, s FROM r2 WHERE {at})) WHERE x.text IS NOT NULL"


_NO = r"附录\s*[A-Z]+(?:\s*[.．]\s*\d+)*|[A-Z]+(?:\s*[.．]\s*\d+)+|\d+(?:\s*[.．]\s*\d+)*|[Oo](?:\s*[.．]\s*\d+)*"
_ALONE = r"附录\s*[A-Z]+(?:\s*[.．]\s*\d+)*|[A-Z]{1,4}(?:\s*[.．]\s*\d+)+|\d+(?:\s*[.．]\s*\d+)+|[Oo](?:\s*[.．]\s*\d+)+"
_PLAIN = lambda x: f"replace(regexp_replace({x}, '\\s', '', 'g'), '．', '.')"
_STAT = lambda x: f"({x} IN ('前言', '目次', 'Contents', '条文说明', '公告', '引用标准名录', '标准用词说明') OR starts_with({x}, '前言') OR contains({x}, '条文说明') OR regexp_matches({x}, '(用词说明|用词用语说明|公告)$'))"
_PAGE = lambda x: f"regexp_matches({x}, '^第\\s*\\d+\\s*页$')"

MD = rf"""raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s0, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) - 1 AS last FROM documents), r2 AS (SELECT doc_id, line, last, trim(s0) AS s, line // 6 + 1 AS no FROM raw),
r3 AS (SELECT *, doc_id % 4 = 0 AND line < 2 AS bare, CASE WHEN doc_id % 4 = 0 AND line < 2 THEN NULL WHEN line % 36 = 18 THEN 0 WHEN line % 6 = 0 THEN 15 WHEN line % 6 = 1 THEN 30 WHEN line % 6 = 3 THEN 12 WHEN line % 12 = 5 THEN 10 END AS cut FROM r2),
md AS (SELECT doc_id, line * 2 AS line, trim(CASE WHEN bare THEN s WHEN line % 36 = 18 THEN '# ' || no || ' 本规范用词说明' WHEN line % 6 = 0 THEN '# ' || no || ' ' || trim(s[1:15]) WHEN line % 6 = 1 THEN no || '.1 ' || trim(s[1:30]) WHEN line % 6 = 3 THEN no || '.2 ' || trim(s[1:12]) WHEN line % 6 = 4 THEN no || '.2.1 ' || s WHEN line % 12 = 5 THEN '# 1 ' || trim(s[1:10]) ELSE s END) AS text FROM r3
UNION ALL SELECT doc_id, line * 2 + 1, trim(s[cut + 1:]) FROM r3 WHERE cut IS NOT NULL AND trim(s[cut + 1:]) <> ''
UNION ALL {_added_sql(FRONT, "line = 0")} UNION ALL {_added_sql(BACK, "line = last")}),
b0 AS (SELECT *, regexp_matches(text, '^#{{1,6}}\s') AS marked, trim(regexp_replace(text, '^#{{1,6}}\s+', '')) AS t FROM md),
b1 AS (SELECT *, CASE WHEN t <> '' THEN marked OR regexp_matches(t, '[。；：.！？]$') END AS edge FROM b0),
b AS (SELECT *, last_value(edge IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_edge, max(CAST(NOT marked AND regexp_replace(t, '^附[：:]\s*', '') = '条文说明' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line) = 1 AS commentary FROM b1),
x0 AS (SELECT *, regexp_extract(t, '^({_NO})\s+.+$', 1) AS n0, regexp_replace(regexp_extract(t, '^(?:{_NO})\s+(.+)$', 1), '[ .…]+$', '') AS rest, regexp_extract(t, '^({_ALONE})\s*$', 1) AS tok, trim(regexp_replace(t, '\s{{2,}}', '', 'g')) AS name FROM b),
x AS (SELECT *, {_PLAIN("n0")} AS n, {_PLAIN("tok")} AS tn, trim(regexp_replace(rest, '\s{{2,}}', '', 'g')) AS ttl FROM x0),
g AS (SELECT *, CASE WHEN marked AND regexp_matches(n, '^\d+$') AND NOT regexp_matches(n, '^(19|20)\d{{2}}$') AND NOT regexp_matches(rest, '[。；：.！？]$') AND NOT commentary THEN CAST(n AS BIGINT) END AS whole,
 NOT marked AND n0 <> '' AND rest <> '' AND NOT regexp_matches(t, '[.．]{{5,}}|…{{2,}}\s*\d{{1,4}}\s*$|^第\s*\d+\s*页|^\d{{4}}-\d{{2}}-\d{{2}}|^\d{{2,4}}\s*年') AND regexp_matches(t, '\p{{L}}') AND NOT starts_with(n, '0') AND NOT regexp_matches(n, '^\d+$') AS with_text FROM x),
cand AS (SELECT doc_id, line, text, t, marked, commentary, whole, CASE WHEN t = '' THEN NULL
 WHEN marked AND n0 <> '' THEN CASE WHEN NOT regexp_matches(n, '^(19|20)\d{{2}}$') AND NOT (regexp_matches(n, '^\d+$') AND regexp_matches(rest, '[。；：.！？]$')) AND ({_STAT("ttl")} OR (n NOT LIKE '%.0' AND regexp_matches(t, '\p{{L}}'))) THEN n END
 WHEN marked AND tok <> '' THEN CASE WHEN tn NOT LIKE '%.0' THEN tn END WHEN marked THEN CASE WHEN {_PAGE("name")} OR {_STAT("name")} THEN name END
 WHEN with_text THEN CASE WHEN n NOT LIKE '%.0' THEN n END WHEN after_edge AND tok <> '' AND tn NOT LIKE '%.0' THEN tn END AS no,
 CASE WHEN marked AND n0 <> '' THEN ttl WHEN marked AND tok <> '' THEN '' WHEN marked THEN name WHEN with_text THEN rest ELSE '' END AS tail,
 CASE WHEN marked AND n0 = '' AND tok = '' THEN 1 END AS top FROM g),
g2 AS (SELECT * REPLACE (CASE WHEN whole IS NULL OR whole > coalesce(max(whole) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN no END AS no) FROM cand),
acc AS (SELECT * REPLACE (CASE WHEN commentary OR NOT regexp_matches(no, '^\d+(\.\d+)*$') OR row_number() OVER (PARTITION BY doc_id, no ORDER BY line) = 1 THEN no END AS no) FROM g2),
lev AS (SELECT *, trim(regexp_replace(tail, '\s{{2,}}', '', 'g')) IN ('目次', 'Contents') AS filter, CASE WHEN trim(regexp_replace(tail, '\s{{2,}}', '', 'g')) NOT IN ('目次', 'Contents') THEN coalesce(top, least(6, length(no) - length(replace(no, '.', '')) + 1)) END AS level, length(trim(tail)) BETWEEN 1 AND 20 AND NOT regexp_matches(trim(tail), '[。；：.！？]$') AS looks FROM acc WHERE no IS NOT NULL),
up AS (SELECT a.doc_id, a.line, b.line AS at FROM lev a JOIN lev b ON a.doc_id = b.doc_id AND b.line < a.line AND b.level < a.level WHERE NOT EXISTS (SELECT 1 FROM lev c WHERE c.doc_id = a.doc_id AND c.line > b.line AND c.line < a.line AND c.level <= b.level)),
par AS (SELECT up.doc_id, up.line, arg_max(b.no, b.line) AS parent FROM up JOIN lev b ON b.doc_id = up.doc_id AND b.line = up.at GROUP BY ALL),
vote AS (SELECT l.*, l.marked OR (avg(CAST(looks AS INTEGER)) OVER (PARTITION BY l.doc_id, level, coalesce(parent, ''), commentary) > 0.5 AND looks) AS titled FROM lev l LEFT JOIN par p USING (doc_id, line)),
tt AS (SELECT *, CASE WHEN titled THEN trim(regexp_replace(tail, '\s{{2,}}', '', 'g')) ELSE '' END AS title FROM vote),
own AS (SELECT *, NOT filter AND ({_STAT("CASE WHEN title <> '' THEN title ELSE tail END")} OR {_PAGE("CASE WHEN title <> '' THEN title ELSE tail END")} OR commentary) AS own, count(*) FILTER (title <> '' OR filter) OVER (PARTITION BY doc_id ORDER BY line) AS tone FROM tt),
node AS (SELECT *, bool_or(own) OVER (PARTITION BY doc_id, tone ORDER BY line) AS non FROM own),
pth AS (SELECT up.doc_id, up.line, string_agg(trim(b.no || ' ' || b.title), ' > ' ORDER BY b.line) FILTER (NOT b.non) AS path FROM up JOIN node b ON b.doc_id = up.doc_id AND b.line = up.at GROUP BY ALL),
path AS (SELECT n.*, coalesce(p.path, '') AS path FROM node n LEFT JOIN pth p USING (doc_id, line) WHERE NOT n.filter),
seg AS (SELECT *, count(no) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM acc),
body AS (SELECT doc_id, part, min(line) AS line, string_agg(regexp_replace(text, '^#{{1,6}}\s*', ''), chr(10) ORDER BY line) FILTER (no IS NULL AND t <> '' AND NOT regexp_matches(text, '[.．]{{5,}}|…{{2,}}\s*\d{{1,4}}\s*$')) AS txt FROM seg GROUP BY ALL),
heads AS (SELECT doc_id, line, trim(regexp_replace(string_split(txt, chr(10))[1], '\s{{2,}}', '', 'g')) AS name, trim(txt) AS content FROM body WHERE part = 0 AND txt IS NOT NULL AND doc_id IN (SELECT doc_id FROM lev)),
head AS (SELECT doc_id, line, CASE WHEN regexp_matches(name, '^\d+(\.\d+)*$') THEN '~' || name ELSE name END AS no, name AS title, content FROM heads WHERE name NOT IN ('目次', 'Contents')),
leaf AS (SELECT p.doc_id, p.line, p.no, p.title, p.level, p.path, trim(CASE WHEN p.title = '' THEN p.tail || coalesce(chr(10) || b.txt, '') ELSE coalesce(b.txt, '') END, chr(10) || ' ') AS content, p.non FROM path p JOIN body b USING (doc_id, line)),
clauses AS (SELECT doc_id, line, no, title, level, path, content, non OR len([y FOR y IN string_split(content, chr(10)) IF trim(y) <> '' AND NOT regexp_matches(trim(y), '^([ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\s*)?(主控项目|一般项目)$')]) = 0 AS note FROM leaf WHERE content <> ''
UNION ALL SELECT doc_id, line, no, title, 1, '', content, TRUE FROM head)"""


def _clauses(spark, d):
    return S.clause_table(md_lines(spark, d), LETTER)


@query("b4_clean_ocr", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), s AS (SELECT *, trim(t, ' ') AS s FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM s),
k AS (SELECT * FROM n WHERE s = '' OR NOT (regexp_matches(s, '^\d{1,3}$') OR (length(s) <= 20 AND n >= 3 AND NOT regexp_matches(s, '[。；：！？]$') AND length(regexp_replace(s, '[\p{L}\p{N}]', '', 'g')) / length(s) < 0.4)))
SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY line), '') AS cleaned FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id""")
def b4(spark, d):
    return S.clean_ocr(table(spark, d, "documents"))


@query("c1_candidates", f"WITH {MD} SELECT doc_id, line, no, CASE WHEN no IS NOT NULL THEN tail END AS tail FROM cand WHERE no IS NOT NULL")
def c1(spark, d):
    return S.candidates(md_lines(spark, d), LETTER).where("no is not null").select("doc_id", "line", "no", "tail")


@query("c2_clause_numbers", "SELECT p_partkey, p_size || '.0.' || p_partkey AS no, least(6, 3) AS level FROM part")
def c2(spark, d):
    no = S.normalize_clause_no(F.concat(F.col("p_size").cast("string"), F.lit("． O . "), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", no.alias("no")).withColumn("level", S.level_of(F.col("no")))


@query("c4_accepted", f"WITH {MD} SELECT doc_id, line, no FROM acc WHERE no IS NOT NULL")
def c4(spark, d):
    return S.accepted(S.candidates(md_lines(spark, d), LETTER)).where("no is not null").select("doc_id", "line", "no")


@query("c6_title_votes", f"WITH {MD} SELECT doc_id, line, no, titled FROM path")
def c6(spark, d):
    return S.heading_nodes(S.accepted(S.candidates(md_lines(spark, d), LETTER))).select("doc_id", "line", "no", "titled")


@query("c7_section_paths", f"WITH {MD} SELECT doc_id, line, no, path FROM path")
def c7(spark, d):
    return S.heading_nodes(S.accepted(S.candidates(md_lines(spark, d), LETTER))).select("doc_id", "line", "no", "path")


@query("c8_clauses", f"WITH {MD} SELECT doc_id, line, no, title, CAST(level AS INTEGER) AS level, path, content FROM clauses")
def c8(spark, d):
    return _clauses(spark, d).select("doc_id", "line", "no", "title", "level", "path", "content")


@query("c10_notes", f"WITH {MD} SELECT doc_id, line, no, note AS is_non FROM clauses")
def c10(spark, d):
    return _clauses(spark, d).select("doc_id", "line", "no", "is_non")


@query("c11_head_blocks", f"WITH {MD} SELECT doc_id, no, title, content FROM head")
def c11(spark, d):
    return S.head_blocks(md_lines(spark, d), LETTER)


@query("c12_cover", "SELECT doc_id FROM documents WHERE contains(text, 'License')::INTEGER + contains(text, 'MIT')::INTEGER + contains(text, 'licensed')::INTEGER + contains(text, 'version 3')::INTEGER >= 2")
def c12(spark, d):
    return table(spark, d, "documents").where(S.is_cover(F.col("text"), ["License", "MIT", "licensed", "version 3"])).select("doc_id")


@query("c13_degraded", f"WITH {MD}, q AS (SELECT doc_id, line, CASE WHEN regexp_matches(text, '^\\d+(\\.\\d+)+$') THEN 'bare_clause_no' WHEN regexp_matches(text, '^(#+\\s*)?\\d+(\\.\\d+)*\\s*\\S') THEN 'unrecognized_shape' END AS reason FROM acc WHERE no IS NULL) SELECT doc_id, line, reason FROM q WHERE reason IS NOT NULL")
def c13(spark, d):
    return S.degraded_headings(S.accepted(S.candidates(md_lines(spark, d), LETTER)))


@query("c14_ancestors", f"WITH {MD}, r AS (SELECT doc_id AS spec, doc_id * 10000000 + line + 100 AS id, no FROM clauses), f AS (SELECT spec, no, min(id) AS id FROM r GROUP BY ALL), p AS (SELECT r.id, f.id AS a, length(f.no) AS n FROM r JOIN f ON r.spec = f.spec AND starts_with(r.no, f.no || '.') AND f.id < r.id) SELECT id, arg_max(a, n) AS ancestor FROM p GROUP BY id")
def c14(spark, d):
    return S.nearest_ancestors(_clauses(spark, d).select(F.col("doc_id").alias("spec"), (F.col("doc_id") * 10000000 + F.col("line") + 100).alias("id"), "no"))


@query("c15_survey", f"WITH {MD}, dup AS (SELECT doc_id, count(*) AS duplicates FROM (SELECT doc_id, no FROM clauses GROUP BY ALL HAVING count(*) > 1) GROUP BY 1) SELECT doc_id, count(*) AS clauses, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) FILTER (CASE WHEN path = '' THEN 0 ELSE len(string_split(path, ' > ')) END >= level - 1) AS covered, coalesce(any_value(duplicates), 0) AS duplicates FROM clauses LEFT JOIN dup USING (doc_id) GROUP BY doc_id")
def c15(spark, d):
    return S.survey(_clauses(spark, d)).select("doc_id", "clauses", "chars", "covered", "duplicates")


@query("c16_conservation", f"WITH {MD}, n AS (SELECT doc_id, sum(length(content)) AS chars FROM clauses GROUP BY 1) SELECT doc_id, CAST(coalesce(chars, 0) AS BIGINT) AS chars, n_chars AS base FROM documents LEFT JOIN n USING (doc_id) WHERE coalesce(chars, 0) < n_chars - 50")
def c16(spark, d):
    return S.conservation(_clauses(spark, d), table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("base")), 50)


@query("c17_block_labels", "SELECT page_id, len(regexp_extract_all(html, '<(?:p|h1|li)[ >]')) AS anchorable, len(regexp_extract_all(html, '<(?:script|style|nav)[ >]')) AS exempt FROM pages")
def c17(spark, d):
    label = F.explode(F.regexp_extract_all("html", F.lit("<(p|h1|li|script|style|nav)[ >]"), 1)).alias("label")
    b = table(spark, d, "pages").select("page_id", label).groupBy("page_id").agg(F.count_if(F.col("label").isin("p", "h1", "li")).alias("anchorable"), F.count_if(F.col("label").isin("script", "style", "nav")).alias("exempt"))
    return table(spark, d, "pages").select("page_id").join(b, "page_id", "left").fillna(0)


@query("c18_assign_blocks", f"WITH {MD}, z AS (SELECT doc_id, line, last_value(no IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS no FROM acc) SELECT doc_id, line AS start, no FROM z WHERE line % 4 = 0")
def c18(spark, d):
    lines = S.accepted(S.candidates(md_lines(spark, d), LETTER))
    return S.assign_blocks(lines.where("no is not null"), lines.where("line % 4 = 0").select("doc_id", F.col("line").alias("start")))


@query("c3_levels", f"WITH {MD} SELECT level, count(*) AS n FROM (SELECT coalesce(top, least(6, length(no) - length(replace(no, '.', '')) + 1)) AS level FROM cand WHERE no IS NOT NULL) GROUP BY level")
def c3(spark, d):
    return S.candidates(md_lines(spark, d), LETTER).where("no is not null").groupBy("level").agg(F.count("*").alias("n"))


@query("c5_rejected", f"WITH {MD} SELECT c.doc_id, c.line, c.no FROM cand c JOIN acc a ON a.doc_id = c.doc_id AND a.line = c.line WHERE c.no IS NOT NULL AND a.no IS NULL")
def c5(spark, d):
    found = S.candidates(md_lines(spark, d), LETTER)
    return found.where("no is not null").select("doc_id", "line", "no").join(S.accepted(found).where("no is not null"), ["doc_id", "line"], "left_anti")


CONTENTS_MD = MD.replace("WHEN line % 12 = 5 THEN '# 1 '", "WHEN line % 6 = 2 THEN '## Contents' WHEN line % 12 = 5 THEN '# 1 '")


@query("c9_contents", f"WITH {CONTENTS_MD} SELECT doc_id, line, no, content FROM clauses")
def c9(spark, d):
    return S.clause_table(md_lines(spark, d, contents=True), LETTER).select("doc_id", "line", "no", "content")


@query("c15_metrics", f"""WITH {MD}, i AS (SELECT *, CASE WHEN path = '' THEN [] ELSE string_split(path, ' > ') END AS p FROM clauses),
e AS (SELECT *, [x FOR x IN string_split(no, '.')[1:-2] IF x <> '0'] AS segs, regexp_replace(no, '\\.[^.]*$', '') AS up FROM i),
m AS (SELECT doc_id, count(DISTINCT up) AS missing FROM e WHERE NOT note AND contains(no, '.') AND NOT regexp_matches(up, '(^|\\.)0$') AND up NOT IN (SELECT no FROM e x WHERE x.doc_id = e.doc_id AND NOT x.note) AND len([x FOR x IN p IF contains(x, up || ' ')]) = 0 GROUP BY 1)
SELECT doc_id, count(*) AS clauses, count(*) FILTER (NOT regexp_matches(no, '\\d')) AS without_digits, coalesce(round(avg(CASE WHEN NOT note THEN CAST(len(p) > 0 AND len(p) = len(segs) AS INTEGER) END), 4), 0) AS coverage, coalesce(any_value(missing), 0) AS missing FROM e LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def c15b(spark, d):
    lines = md_lines(spark, d)
    judged = S.judged_lines(lines, LETTER)
    m = S.metrics(S.clause_table(lines, judged=judged), S.degraded_headings(judged))
    return m.select("doc_id", "clauses", "without_digits", "coverage", F.size("missing_sections").cast("long").alias("missing"))
