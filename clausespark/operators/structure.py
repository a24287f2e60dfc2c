"""Documents to clauses: headings, their tree and their content, as window jobs over lines (doc_id, line, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark.functions.text import CJK, lines as split_lines, plain_text, strip
from clausespark.tables import stored

# Fixed values that results depend on.
COVER_WORDS = ["中华人民共和国国家标准", "ICS", "中国标准出版社", "出版发行", "代替 GB", "代替 GB/T", "代替 JGJ", "第一版", "印刷", "定价", "书号", "版权专有"]
STATUTORY_TITLES = ["前言", "目次", "Contents", "条文说明", "公告", "引用标准名录", "标准用词说明"]
STATUTORY_ENDS = ["用词说明", "用词用语说明", "公告"]
CONTENTS = ["目次", "Contents"]
DOT_LEADER = r"[.．]{5,}|…{2,}\s*\d{1,4}\s*$"
COMMENTARY = "条文说明"
TITLE_END = "。；：.！？"
GROUP_LABELS = ["主控项目", "一般项目"]
LEVELS = 6
PAGE_MARK = r"(?U)^第\s*\d+\s*页$"
_SEGMENT = r"(?:\d+|[Oo](?=[.．\s]|$))"
_MORE = rf"\s*[.．]\s*{_SEGMENT}"
#: Numbers before a text, and numbers that may stand alone.
NUMBER = rf"附录\s*[A-Z]+(?:{_MORE})*|[A-Z]+(?:{_MORE})+|{_SEGMENT}(?:{_MORE})*"
TOKEN = rf"附录\s*[A-Z]+(?:{_MORE})*|[A-Z]{{1,4}}(?:{_MORE})+|{_SEGMENT}(?:{_MORE})+"
WIDE_DIGITS = "０１２３４５６７８９"


def to_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split_lines(F.coalesce(F.col(text_col), F.lit("")))).alias("line", "text"))


def clean_ocr(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20, least: int = 3) -> DataFrame:
    """(id, text) without page marks, bare page numbers, failure marks and headers that repeat in the document."""
    s = to_lines(docs, id_col, text_col).withColumn("s", F.trim("text"))
    n = s.groupBy("doc_id", "s").agg(F.count("*").alias("n")).where(F.col("n") >= least)  # repeats only
    odd = F.length(F.regexp_replace("s", r"[\p{L}\p{N}]", "")) / F.greatest(F.length("s"), F.lit(1))
    repeated = (F.length("s") <= most) & F.col("n").isNotNull() & ~F.col("s").rlike("[。；：！？]$") & (odd < 0.4)
    drop = F.col("s").rlike("^第[\\s　]*\\d+[\\s　]*页\\s*$") | F.col("s").rlike(r"^\d{1,3}$") | F.col("s").rlike(r"^_?\[OCR 失败") | repeated
    kept = s.join(n, ["doc_id", "s"], "left").where((F.col("s") == "") | ~drop)
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    out = kept.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("cleaned"))
    return docs.select(F.col(id_col).alias("doc_id")).join(out, "doc_id", "left").select(F.col("doc_id").alias(id_col), F.coalesce("cleaned", F.lit("")).alias("cleaned"))


def normalize_clause_no(c: Column) -> Column:
    """Without inner white space, with plain dots, later segments of O as zeros."""
    parts = F.split(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), "．", "."), r"\.", -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when((i > 0) & x.rlike("^[Oo]+$"), F.repeat(F.lit("0"), F.length(x))).otherwise(x)), ".")


def level_of(no: Column) -> Column:
    return F.least(F.lit(LEVELS), F.regexp_count(no, F.lit(r"\.")) + 1)


def clean_title(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s{2,}", ""))


def is_statutory(title: Column) -> Column:
    """Whether a title is that of a block without clauses: a preface, contents, a notice, notes on wording and the like."""
    t = strip(F.coalesce(title, F.lit("")))
    ends = [t.endswith(x) for x in STATUTORY_ENDS]
    return t.isin(*STATUTORY_TITLES) | t.startswith("前言") | F.contains(t, F.lit(COMMENTARY)) | ends[0] | ends[1] | ends[2]


def is_page_mark(title: Column) -> Column:
    return title.rlike(PAGE_MARK)


def candidates(lines: DataFrame, needs: str = f"[{CJK}]") -> DataFrame:
    """lines with marked (a # line), no, tail and level where a line can be a heading (null otherwise), commentary and whole.

    Numbers are dotted, those of appendices or of letters. # lines may also be a number alone, a page mark or a statutory title,
    which are their own number at level 1. Bare lines need a dotted number and a text with `needs`, no dates, page marks, dot
    leaders or numbers from 0; a number alone is one behind a # line or a sentence end. Places of sections without number (the
    last segment 0) are none. commentary is true from the commentary mark on; whole is the number of a chapter before it.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    marked = F.col("text").rlike("(?U)^#{1,6}\\s")
    t = strip(F.when(marked, F.regexp_replace("text", "(?U)^#{1,6}\\s+", "")).otherwise(F.col("text")))
    c = lines.select("doc_id", "line", "text", marked.alias("marked"), t.alias("t"))
    ends = F.when(F.col("t") != "", F.col("marked") | F.col("t").rlike(f"[{TITLE_END}]$"))
    mark = ~F.col("marked") & (F.regexp_replace("t", "(?U)^附[：:]\\s*", "") == COMMENTARY)
    at = lambda i: F.regexp_extract("t", rf"(?Us)^({NUMBER})\s+(.+)$", i)
    c = c.select(
        "*", F.last(ends, True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("edge"), F.bool_or(mark).over(w).alias("commentary"),
        at(1).alias("number"), F.regexp_replace(at(2), "[ .…]+$", "").alias("rest"), F.regexp_extract("t", rf"(?U)^({TOKEN})\s*$", 1).alias("token"),
    )
    alone = normalize_clause_no(F.col("token"))
    c = c.select("*", normalize_clause_no(F.col("number")).alias("n"), clean_title(F.col("rest")).alias("title"), alone.alias("alone"), clean_title(F.regexp_replace("t", r"(?U)^[\d．.]+\s+(?=\S)", "")).alias("name"))
    n, title = F.col("n"), F.col("title")
    digits, zero = n.rlike(r"(?U)^\d+$"), lambda x: x.endswith(".0")
    numbered = F.col("number") != ""
    open_ = ~n.rlike(r"^(19|20)\d{2}$") & ~(digits & F.col("rest").rlike(f"[{TITLE_END}]$"))
    chapter = F.col("marked") & numbered & open_ & digits & ~F.col("commentary")
    named = is_page_mark(F.col("name")) | is_statutory(F.col("name"))
    lone = F.when((F.col("token") != "") & ~zero(F.col("alone")), F.col("alone"))
    kept = is_statutory(title) | (~zero(n) & F.col("t").rlike(needs))
    of_marked = F.when(numbered, F.when(open_ & kept, n)).when(F.col("token") != "", lone).when(named, F.col("name"))
    odd = F.col("t").rlike(DOT_LEADER) | F.col("t").rlike(r"(?U)^第\s*\d+\s*页|^\d{4}-\d{2}-\d{2}|^\d{2,4}\s*年")
    text_like = numbered & ~odd & F.col("t").rlike(needs) & (F.col("rest") != "") & ~n.startswith("0") & ~digits
    of_bare = F.when(text_like, F.when(~zero(n), n)).when(F.col("edge"), lone)
    no = F.when(F.col("t") == "", None).when(F.col("marked"), of_marked).otherwise(of_bare)
    own = F.when(F.col("marked"), F.when(numbered, title).when(F.col("token") != "", "").otherwise(F.col("name"))).when(text_like, F.col("rest")).otherwise("")
    c = c.select("doc_id", "line", "text", "marked", "number", "token", no.alias("no"), own.alias("own"), F.when(chapter, F.translate("n", WIDE_DIGITS, "0123456789").cast("long")).alias("whole"), "commentary")
    has = F.col("no").isNotNull()
    level = F.when(has, F.when(F.col("marked") & (F.col("number") == "") & (F.col("token") == ""), 1).otherwise(level_of(F.col("no"))))
    return c.select("doc_id", "line", "text", "marked", "no", F.when(has, F.col("own")).alias("tail"), level.alias("level"), "commentary", "whole")


def accepted(found: DataFrame) -> DataFrame:
    """candidates that stay headings: chapters grow along the body, and no number comes twice in it; in commentary all stay.

    Appendices, letters, page marks and titles are no numbers in this sense.
    """
    past = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    grows = F.col("whole").isNull() | (F.col("whole") > F.coalesce(F.max("whole").over(past), F.lit(-1)))
    f = found.withColumn("grows", grows).withColumn("no", F.when(F.col("grows"), F.col("no")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "no").orderBy("line"))
    f = f.withColumn("no", F.when(F.col("commentary") | ~F.col("no").rlike(r"(?U)^\d+(\.\d+)*$") | (nth == 1), F.col("no")))
    keep = F.col("no").isNotNull()
    return f.select("doc_id", "line", "text", "marked", "no", F.when(keep, F.col("tail")).alias("tail"), F.when(keep, F.col("level")).alias("level"), "commentary")


def judged_lines(lines: DataFrame, needs: str = f"[{CJK}]") -> DataFrame:
    """The accepted lines as a table, as what is made of them reads them several times."""
    return stored(accepted(candidates(lines, needs)), "judged-lines")


def looks_like_title(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) > 0) & (F.length(t) <= 20) & ~t.rlike(f"[{TITLE_END}]$")


def _open_headings(nodes: DataFrame, fields: list[str]) -> tuple[DataFrame, list[Column]]:
    """nodes with columns at1 to at5, and of each level the last heading (line and fields) if it is still open at a node."""
    past = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumns({f"at{k}": F.max(F.when(F.col("level") == k, F.struct("line", *fields))).over(past) for k in range(1, LEVELS)})
    found, highest = [], F.lit(-(1 << 31))
    for k in range(1, LEVELS):
        at = F.col(f"at{k}")
        found.append(F.when((F.col("level") > k) & (at["line"] > highest), at))
        highest = F.greatest(highest, F.coalesce(at["line"], F.lit(-(1 << 31))))
    return n, found


def vote_titles(nodes: DataFrame) -> DataFrame:
    """nodes with titled: marked ones, and lines that look like titles where most of their siblings do.

    Siblings have the same level and the same open heading above, on the same side of the commentary mark. Contents pages
    (filter, if nodes have that column) have no level and no vote.
    """
    n, above = _open_headings(nodes, ["no"])
    n = n.withColumn("parent_no", F.coalesce(*[a["no"] for a in reversed(above)], F.lit(""))).drop(*[f"at{k}" for k in range(1, LEVELS)])
    vote = F.avg(looks_like_title(F.col("tail")).cast("int")).over(Window.partitionBy("doc_id", "level", "parent_no", "commentary")) > 0.5
    return n.withColumn("titled", F.col("marked") | (vote & looks_like_title(F.col("tail")))).drop("parent_no")


def flag_notes(nodes: DataFrame) -> DataFrame:
    """nodes of vote_titles with title and is_non: statutory titles and page marks, untitled ones behind them, all commentary.

    A titled heading or a contents page (filter) sets the tone anew.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    n = nodes.withColumn("title", F.when(F.col("titled"), clean_title(F.col("tail"))).otherwise(""))
    name = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("tail"))
    own = ~F.col("filter") & (is_statutory(name) | is_page_mark(name) | F.col("commentary"))
    n = n.withColumns({"own": own, "tone": F.count_if((F.col("title") != "") | F.col("filter")).over(w)})
    return n.withColumn("is_non", F.bool_or("own").over(Window.partitionBy("doc_id", "tone").orderBy("line"))).drop("own", "tone")


def section_paths(nodes: DataFrame) -> DataFrame:
    """nodes of flag_notes with path: the open headings of smaller levels, `no title > no title`, itself and notes left out."""
    named = nodes.withColumn("name", strip(F.concat("no", F.lit(" "), "title")))
    n, above = _open_headings(named, ["name", "is_non"])
    path = F.concat_ws(" > ", *[F.when(~a["is_non"], a["name"]) for a in above])
    return n.withColumn("path", path).drop("name", *[f"at{k}" for k in range(1, LEVELS)])


def heading_nodes(found: DataFrame) -> DataFrame:
    """The headings of accepted lines, contents pages left out: (doc_id, line, no, tail, level, marked, titled, title, is_non, path)."""
    n = found.where("no is not null").withColumn("filter", clean_title(F.col("tail")).isin(*CONTENTS))
    n = section_paths(flag_notes(vote_titles(n.withColumn("level", F.when(~F.col("filter"), F.col("level"))))))
    return n.where("not filter").select("doc_id", "line", "no", "tail", "level", "marked", "commentary", "titled", "title", "is_non", "path")


def label_only(content: Column) -> Column:
    """Whether every line of a content is the label of a group of clauses, with a roman numeral or without."""
    own = F.filter(F.transform(split_lines(content), strip), lambda x: x != "")
    return (F.size(own) > 0) & F.forall(own, lambda x: F.regexp_replace(x, r"(?U)^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\s*", "").isin(*GROUP_LABELS))


def clause_table(lines: DataFrame, needs: str = f"[{CJK}]", judged: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, no, title, level, path, content, is_non): the clauses of each document, a table as its users read it often.

    Lines that are judged already (judged_lines) are not judged again.

    Lines belong to the heading before them; # marks and dot-leader lines go, the tail of an untitled heading is its first
    line, titled headings without content are left out, contents pages swallow their text. Lines before the first heading are a
    note of their own, under their first line (with ~ before a number), unless that is the title of a contents page. Notes are
    flagged as flag_notes has it, and those of which the content is labels alone.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    judged = judged_lines(lines, needs) if judged is None else judged
    f = judged.withColumn("part", F.count("no").over(w))
    body = F.when(F.col("no").isNull() & (strip(F.col("text")) != "") & ~F.col("text").rlike(DOT_LEADER), F.regexp_replace("text", "(?U)^#{1,6}\\s*", ""))
    heading = F.struct("no", "tail", "level", "marked", "commentary")
    g = f.groupBy("doc_id", "part").agg(
        F.min("line").alias("line"), F.max(F.when(F.col("no").isNotNull(), heading)).alias("h"),
        F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("line", body.alias("b"))))).alias("lines"),
    )
    g = g.select("doc_id", "line", F.transform("lines", lambda x: x["b"]).alias("lines"), "h.*", F.max("part").over(Window.partitionBy("doc_id")).alias("parts"))
    g = stored(g, "parts")
    head = g.where("no is null and parts > 0").withColumn("name", clean_title(F.coalesce(F.get("lines", F.lit(0)), F.lit(""))))
    head = head.where((F.col("name") != "") & ~F.col("name").isin(*CONTENTS))
    stray = F.when(F.col("name").rlike(r"(?U)^\d+(\.\d+)*$"), F.concat(F.lit("~"), "name")).otherwise(F.col("name"))
    joined = lambda c: strip(F.array_join(c, "\n"))
    head = head.select("doc_id", "line", stray.alias("no"), F.col("name").alias("title"), F.lit(1).alias("level"), F.lit("").alias("path"), joined(F.col("lines")).alias("content"), F.lit(True).alias("is_non"))
    n = g.where("no is not null").withColumn("filter", clean_title(F.col("tail")).isin(*CONTENTS)).withColumn("level", F.when(~F.col("filter"), F.col("level")))
    n = section_paths(flag_notes(vote_titles(n))).where("not filter")
    content = joined(F.when(F.col("title") == "", F.concat(F.array("tail"), "lines")).otherwise(F.col("lines")))
    n = n.select("doc_id", "line", "no", "title", "level", "path", content.alias("content"), "is_non").where("content <> ''")
    n = n.withColumn("is_non", F.col("is_non") | label_only(F.col("content")))
    return stored(n.unionByName(head), "clauses")


def head_blocks(lines: DataFrame, needs: str = f"[{CJK}]") -> DataFrame:
    """(doc_id, no, title, content) of the text before a document's first heading, as clause_table has it."""
    judged = judged_lines(lines, needs)
    rows = clause_table(lines, judged=judged).where("is_non and level = 1 and path = ''")
    first = judged.where("no is not null").groupBy("doc_id").agg(F.min("line").alias("first"))
    return rows.join(first, "doc_id").where("line < first").select("doc_id", "no", "title", "content")


def is_cover(content: Column, words: list[str] | None = None) -> Column:
    return sum((F.contains(content, F.lit(w)).cast("int") for w in words or COVER_WORDS), F.lit(0)) >= 2


def degraded_headings(found: DataFrame) -> DataFrame:
    """(doc_id, line, reason): lines like headings by a looser look that are none."""
    t = F.trim("text")
    reason = F.when(t.rlike(r"^\d+(\.\d+)+$"), "bare_clause_no").when(t.rlike(r"^(#+\s*)?\d+(\.\d+)*\s*\S"), "unrecognized_shape")
    return found.where("no is null").select("doc_id", "line", reason.alias("reason")).where("reason is not null")


def nearest_ancestors(rows: DataFrame) -> DataFrame:
    """(id, ancestor) for rows (spec, id, no): the longest dotted prefix that an earlier row of the spec has, its first row."""
    firsts = rows.groupBy("spec", "no").agg(F.min("id").alias("ancestor"))
    parts = F.split("no", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    p = rows.where(F.col("no").contains(".")).select("spec", "id", F.explode(prefixes).alias("no"))
    return p.join(firsts, ["spec", "no"]).where("ancestor < id").groupBy("id").agg(F.max_by("ancestor", F.length("no")).alias("ancestor"))


def survey(clauses: DataFrame) -> DataFrame:
    """One row of counts for each document."""
    expected = F.col("level") - 1
    have = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", " > ")))
    dup = clauses.groupBy("doc_id", "no").agg(F.count("*").alias("n")).where("n > 1").groupBy("doc_id").agg(F.count("*").alias("duplicates"))
    s = clauses.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.sum(F.length("content")).alias("chars"), F.sum(F.length(plain_text("content"))).alias("plain_chars"), F.count_if(have >= expected).alias("covered"), F.count_if("is_non").alias("notes"))
    return s.join(dup, "doc_id", "left").fillna(0, ["duplicates"])


def metrics(clauses: DataFrame, degraded: DataFrame) -> DataFrame:
    """The twelve figures of each document: rows, raw and plain characters, numbers without digits, share of complete paths,
    missing sections, repeated numbers with their rows and those that are notes, their groups by kind, and degraded lines.

    Paths and sections are judged on clauses that are no notes; a number has one ancestor for each leading segment but 0.
    A group of equal numbers is designed (clauses and notes), body_only or commentary_only.
    """
    parts = F.split("no", r"\.")
    leading = F.slice(parts, 1, F.size(parts) - 1)
    up = F.array_join(leading, ".")
    path = F.filter(F.split("path", " > "), lambda x: x != "")
    c = clauses.withColumns({"expected": F.size(F.filter(leading, lambda x: x != "0")), "up": up, "p": path, "real": ~F.col("is_non")})
    whole = F.when(F.col("real"), ((F.size("p") > 0) & (F.size("p") == F.col("expected"))).cast("int"))
    raw, plain = F.sum(F.length("content")), F.sum(F.length(plain_text("content")))
    out = c.groupBy("doc_id").agg(F.count("*").alias("clauses"), raw.alias("chars"), plain.alias("plain_chars"), F.count_if(~F.col("no").rlike("[0-9]")).alias("without_digits"), F.coalesce(F.round(F.avg(whole), 4), F.lit(0.0)).alias("coverage"))
    wanted = c.where(F.col("real") & F.contains("no", F.lit(".")) & ~F.col("up").rlike(r"(^|\.)0$")).where(~F.exists("p", lambda x: F.contains(x, F.concat("up", F.lit(" ")))))
    present = c.where("real").select("doc_id", F.col("no").alias("up")).distinct()
    missing = wanted.select("doc_id", "up").distinct().join(present, ["doc_id", "up"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("up")).alias("missing_sections"))
    kind = F.when(F.bool_and("is_non"), "commentary_only").when(F.bool_or("is_non"), "designed").otherwise("body_only")
    groups = c.groupBy("doc_id", "no").agg(F.count("*").alias("n"), F.count_if("is_non").alias("notes"), kind.alias("kind")).where("n > 1")
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("no")))).alias(k)
    repeated = groups.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("no", "n"))).alias("duplicates"), F.sum("n").alias("duplicate_rows"), F.sum("notes").alias("duplicate_notes"), of("designed"), of("body_only"), of("commentary_only"))
    odd = degraded.groupBy("doc_id").agg(F.count("*").alias("degraded"))
    none = F.array().cast("array<string>")
    j = out.join(missing, "doc_id", "left").join(repeated, "doc_id", "left").join(odd, "doc_id", "left").fillna(0, ["duplicate_rows", "duplicate_notes", "degraded"])
    return j.withColumns({k: F.coalesce(k, none) for k in ("missing_sections", "designed", "body_only", "commentary_only")})


def conservation(clauses: DataFrame, baseline: DataFrame, slack: int = 5000) -> DataFrame:
    """(doc_id, chars, base): documents whose clauses have lost over `slack` characters against the baseline."""
    n = clauses.groupBy("doc_id").agg(F.sum(F.length("content")).alias("chars"))
    return baseline.join(n, "doc_id", "left").select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), "base").where(F.col("chars") < F.col("base") - slack)


def assign_blocks(headings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, start, no): each block gets the last heading at or before its start, null before the first one."""
    both = headings.select("doc_id", F.col("line").alias("at"), F.lit(0).alias("side"), "no").unionByName(blocks.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("no")))
    last = F.last("no", True).over(Window.partitionBy("doc_id").orderBy("at", "side"))
    return both.withColumn("no", last).where("side = 1").select("doc_id", F.col("at").alias("start"), "no")
