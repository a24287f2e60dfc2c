"""Text derivations as column expressions; a null text counts as empty unless said otherwise."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
BLOCK_TAGS = ["div", "p", "br", "table", "tr", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6"]
SENTENCE_END = "。；！？.!?;"
SUMMARY_END = "。；！？："
LATEX = r"(?s)\$\$.*?\$\$|\$[^$\n]{1,200}\$|\\\(.*?\\\)|\\\[.*?\\\]"
RECOMMENDED = {"GBT": "GB/T", "JTT": "JT/T", "JTGT": "JTG/T", "JGT": "JG/T", "CJT": "CJ/T", "JBT": "JB/T", "NYT": "NY/T", "DBT": "DB/T", "JGJT": "JGJ/T"}
PREFIXES = [("JTGT", "公路工程"), ("JTG", "公路工程"), ("JTT", "交通运输"), ("JT", "交通运输"), ("JGT", "建筑工业"), ("JGJ", "建筑工程"), ("JG", "建筑工业"), ("CJT", "城镇建设"), ("CJ", "城镇建设"), ("JBT", "机械"), ("JB", "机械"), ("NYT", "农业"), ("NY", "农业"), ("GBT", ""), ("GB", ""), ("TB", "铁路"), ("MH", "民用航空"), ("YZ", "邮政"), ("DB", "")]
CODE_PREFIXES = ["JTGT", "JTG", "JTT", "JT", "JGT", "JG", "JGJ", "CJT", "CJ", "JBT", "JB", "NYT", "NY", "GBT", "GB", "TB", "MH", "YZ", "DB", "DBT", "T", "Q", "CJJ", "GJB", "GBZ", "GBJ", "JJG", "JJF", "XB", "QC", "JGJT"]
CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
#: White space within a line.
INLINE_SPACE = " \t\x0b\f\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TABLE_TO_CENTRE = r"(?i)<table(?![^>]*\balign=)(?![^>]*margin-left\s*:\s*auto)([^>]*)>"
NOISE_WORDS = ["扫描件", "高清", "副本", "打印版", "电子版", "完整版", "无水印", "正版", "OCR"]
TAIL_NOISE_WORDS = ["扫描件", "高清", "副本", "打印版", "电子版", "完整版", "无水印", "OCR"]
DASHES = "-‐‑‒–—―⁃﹘﹣－"
TITLE_EDGE = " 　.,，、。;；:：!！?？\\-—_·…"
TITLE_VERSION = r"[（(]\s*\d{4}\s*(?:年版|版)?\s*[）)]$"
STOP_WORDS = [
    "的", "和", "是", "在", "了", "不", "与", "及", "或", "应", "其", "为", "等", "以", "中", "对", "按", "可", "须", "均", "时", "于", "并", "则",
    "规定", "要求", "采用", "符合", "进行", "使用", "必须", "不得", "本",
]
UNKNOWN_SPEC, UNKNOWN_STATUS, UNKNOWN_NATURE, UNKNOWN_USAGE = "未知规范", "状态未标注", "性质未标注", "适用范围未标注"


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r\u00a0\u3000"))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _character(code: Column) -> Column:
    """The character of a numeric reference: of Windows-1252 for C1 controls, U+FFFD for none, nothing for controls and non-characters."""
    odd = {i: bytes([i]).decode("cp1252", "replace") for i in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
    names = F.from_json(F.lit(json.dumps({str(k): chr(k) if v == "\ufffd" and k else v for k, v in odd.items()})), "map<string,string>")
    bad = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    low = code.bitwiseAND(0xFFFF)
    none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 65).otherwise(code)), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(names, code.cast("string")), F.when(bad, "\ufffd").when(none, "").otherwise(char))


def _reference(e: Column, closed: bool) -> Column:
    """What a character reference stands for; of names the longest known beginning counts, the rest stays. Closed ones count whole."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    number = F.regexp_extract(e, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    short = F.substring(F.concat(F.lit("0"), number), 1, 8)  # more digits are beyond all characters
    code = F.when(e.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("long")
    code = F.when(F.length(number) > 7, 0x110000).otherwise(code)
    name = F.substring(e, F.lit(2), F.length(e))
    known = F.try_element_at(names, name)
    for n in () if closed else range(max(len(k) for k in html5 if not k.endswith(";")), 1, -1):
        known = F.coalesce(known, F.when(F.length(name) > n, F.concat(F.try_element_at(names, F.substring(name, 1, n)), F.substring(name, F.lit(n + 1), F.length(name)))))
    return F.when(e.startswith("&#"), bound(code, _character)).otherwise(F.coalesce(known, e))


def unescape(c: Column | str, closed: bool = False) -> Column:
    """Character references read as browsers do, named (those of HTML 5) and numeric ones, in one pass; unknown names stay.

    With closed only those that end in a semicolon are read.
    """
    end = ";" if closed else ";?"
    reference = f"&(?:#[0-9]+{end}|#[xX][0-9a-fA-F]+{end}|[^\\t\\n\\f <&#;]{{1,32}}{end})"

    def read(t: Column) -> Column:
        found = F.concat(F.transform(F.regexp_extract_all(t, F.lit(reference), 0), lambda e: _reference(e, closed)), F.array(F.lit("")))
        whole = F.array_join(F.zip_with(F.split(t, reference, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(F.contains(t, F.lit("&")), whole).otherwise(t)

    return bound(text(c), read)


#: Stands for a tag while character references are read, so that none is read across it.
_TAG = "\ufdd0\ufdd1\ufdd0"


def strip_html(c: Column | str, closed: bool = False) -> Column:
    """Text of markup: block tags end lines, other tags and comments vanish, character references are read, blank lines go.

    Bodies of script and style stay, as only tags are handled. With closed, references without a semicolon stay.
    """
    t = F.regexp_replace(text(c), r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</?(?:" + "|".join(BLOCK_TAGS) + r")(?:\s[^>]*)?/?>", "\n")
    t = F.replace(unescape(F.regexp_replace(t, r"</?[a-zA-Z!][^>]*>", _TAG), closed), F.lit(_TAG), F.lit(""))
    t = F.regexp_replace(t, "[ \\t\u3000]+", " ")
    return F.array_join(F.filter(F.transform(lines(t), strip), lambda x: x != ""), "\n")


def plain_text(c: Column | str, closed: bool = False) -> Column:
    """strip_html with table cells apart and formulas between dollar signs or \\( \\) and \\[ \\] left out."""
    spaced = F.regexp_replace(text(c), r"(?i)</?t[dh][^>]*>", " ")
    return strip_html(F.regexp_replace(strip_html(spaced, closed), LATEX, " "), closed)


def normalize_cjk_spacing(c: Column | str) -> Column:
    """Without white space, but for line ends, between two ideographs."""
    return F.regexp_replace(text(c), f"(?<=[{CJK}])[{INLINE_SPACE}]+(?=[{CJK}])", "")


def normalize_md(c: Column | str) -> Column:
    """A written-out \\n becomes <br>, and a table without alignment is centred; lines stay lines."""
    t = F.replace(text(c), F.lit("\\n"), F.lit("<br>"))
    return F.regexp_replace(t, TABLE_TO_CENTRE, '<table align="center"$1>')


def token_runs(c: Column | str) -> Column:
    """The tokens of each run of letters and digits or of ideographs, in an array each: a run of ideographs is its neighbours' pairs."""
    runs = F.regexp_extract_all(F.lower(text(c)), F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), 0)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))
    return F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]") & (F.length(r) > 1), pairs(r)).otherwise(F.array(r)))


def token_text(c: Column | str) -> Column:
    """What token_runs cuts: lower-case runs of letters, digits and ideographs with a space for all that is between them."""
    return F.regexp_replace(F.lower(text(c)), f"[^{CJK}\\p{{L}}\\p{{N}}]+", " ")


def tokenize(c: Column | str) -> Column:
    """Lower-case runs of letters and digits; of ideographs every pair of neighbours, and one that stands alone.

    What has no ideographs is cut at spaces, which takes less than a step for each token.
    """
    words = lambda t: F.when(t == "", F.array().cast("array<string>")).when(t.rlike(f"[{CJK}]"), F.flatten(token_runs(t))).otherwise(F.split(t, " ", -1))
    return bound(F.trim(token_text(c)), words)


def estimate_tokens(c: Column | str, chars_per_token: int = 2) -> Column:
    return F.ceil(F.length(text(c)) / max(chars_per_token, 1)).cast("int")


def split_values(c: Column | str) -> Column:
    """The trimmed parts of a comma list that are not blank."""
    return F.filter(F.transform(F.split(text(c), ",", -1), lambda x: F.trim(x)), lambda x: x != "")


def build_embed_text(code: Column, title: Column, clause_no: Column, clause_title: Column, content: Column, path: Column) -> Column:
    """What is embedded: code, title, [number], path, clause title and content, as plain text."""
    s = [text(x) for x in (code, title, clause_no, path, clause_title, content)]
    return strip(plain_text(F.concat(s[0], F.lit(" "), s[1], F.lit(" ["), s[2], F.lit("] "), s[3], F.lit(" "), s[4], F.lit(" "), s[5])))


def chunks(c: Column | str, limit: Column | int = 512) -> Column:
    """Pieces of at most `limit` characters of a plain text, cut at sentences where it can be.

    A new piece starts with the last sentence of the one before it if that has under a tenth of limit, is not all of it,
    and leaves room for the next sentence. A fold over the sentences' lengths finds the first and last sentence of each
    piece, and the pieces are joined from those, so the time grows with the text's length.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    t = text(c)
    hard = lambda u: F.when(F.length(u) > limit, F.regexp_extract_all(u, F.concat(F.lit("(?s).{1,"), limit.cast("string"), F.lit("}")), 0)).otherwise(F.array(u))
    overlap = F.floor(limit * F.lit(0.1)).cast("int")
    none = F.array().cast("array<struct<first:int,next:int>>")

    def step(acc: Column, x: Column) -> Column:
        full = (acc["size"] > 0) & (acc["size"] + x["n"] > limit)
        again = (acc["at"] - acc["first"] > 1) & acc["begins"] & (acc["n"] < overlap) & (acc["n"] + x["n"] <= limit)
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(full, acc["at"] - again.cast("int")).otherwise(acc["first"]).alias("first"),
            F.when(full, x["n"] + F.when(again, acc["n"]).otherwise(0)).otherwise(acc["size"] + x["n"]).alias("size"),
            x["n"].alias("n"), acc["ends"].alias("begins"), x["ends"].alias("ends"),
            F.when(full, F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["at"].alias("next"))))).otherwise(acc["out"]).alias("out"),
        )

    def pieces(units: Column) -> Column:
        facts = F.transform(units, lambda u: F.struct(F.length(u).alias("n"), u.rlike(f"[{SENTENCE_END}]$").alias("ends")))
        zero, no = F.lit(0), F.lit(False)
        start = F.struct(zero.alias("at"), zero.alias("first"), zero.alias("size"), zero.alias("n"), no.alias("begins"), no.alias("ends"), none.alias("out"))
        cuts = F.aggregate(facts, start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["at"].alias("next")))))
        return F.transform(cuts, lambda x: F.array_join(F.slice(units, x["first"] + 1, x["next"] - x["first"]), ""))

    units = F.flatten(F.transform(F.filter(F.split(t, f"(?<=[{SENTENCE_END}])", -1), lambda u: u != ""), hard))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= limit, F.array(t)).otherwise(bound(units, pieces))


def _close_math(t: Column) -> Column:
    cut = F.regexp_extract(t, r"(?s)^(.+)\$[^$]*$", 1)
    return F.when((F.regexp_count(t, F.lit(r"\$")) % 2 == 1) & (cut != ""), cut).otherwise(t)


def make_summary(c: Column | str, limit: int = 200, title: Column | None = None, closed: bool = False) -> Column:
    """The first paragraph (the second if that has under 20 characters), cut at a late sentence end and an open formula.

    closed is that of strip_html.
    """
    def pick(paragraphs: Column) -> Column:
        first, second = F.get(paragraphs, F.lit(0)), F.get(paragraphs, F.lit(1))
        return F.when((F.length(first) < 20) & second.isNotNull(), second).otherwise(first)

    def shorten(seg: Column) -> Column:
        cut = F.substring(seg, 1, limit)
        last = F.regexp_extract(cut, f"(?s)^(.*[{SUMMARY_END}])", 1)
        return F.when(F.length(seg) <= limit, seg).when(F.length(last) > limit // 2 + 1, last).otherwise(cut)

    seg = bound(F.filter(lines(strip_html(c, closed)), lambda x: x != ""), pick)
    seg = bound(bound(seg, shorten), _close_math)
    if title is not None:
        seg = F.when(text(title) != "", F.concat(F.lit("["), title, F.lit("] "), seg)).otherwise(seg)
    return F.coalesce(strip(seg), F.lit(""))


def safe_summary(c: Column | str, limit: int = 200) -> Column:
    return _close_math(F.substring(text(c), 1, limit))


def build_meta(code: Column, title: Column, status: Column, clause_no: Column, usage: Column, nature: Column) -> Column:
    some = lambda c, other: F.when(F.trim(text(c)) == "", F.lit(other)).otherwise(F.trim(text(c)))
    return F.concat(F.lit("【《"), some(code, UNKNOWN_SPEC), F.lit("》"), text(title), F.lit("｜"), some(status, UNKNOWN_STATUS), F.lit("｜条文 "), some(clause_no, "?"), F.lit("｜性质："), some(nature, UNKNOWN_NATURE), F.lit("｜适用范围："), some(usage, UNKNOWN_USAGE), F.lit("】"))


def normalize_spec_code(c: Column | str) -> Column:
    """Dashes alike, a recommended prefix with /T, single spaces and none around a dash."""
    t = F.translate(F.trim(text(c)), "—－–\u3000", "--- ")
    letters = F.upper(F.regexp_extract(t, "^([A-Za-z]+)", 1))
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in RECOMMENDED.items() for x in kv]), letters)
    t = F.when(fixed.isNotNull(), F.concat(fixed, F.substring(t, F.length(letters) + 1, F.lit(10_000)))).otherwise(t)
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"\s*-\s*", "-")


def _prefixed(c: Column, value) -> Column:
    out = None
    for prefix, industry in PREFIXES:
        out = F.when(c.startswith(prefix), value(prefix, industry)) if out is None else out.when(c.startswith(prefix), value(prefix, industry))
    return out


def detect_hierarchy(code: Column) -> Column:
    c = F.trim(F.replace(text(code), F.lit("/"), F.lit("")))
    level = _prefixed(c, lambda p, _: "国家标准" if p in ("GB", "GBT") else "地方标准" if p in ("DB", "DBT") else "行业标准")
    return level.when(c.startswith("T"), "团体标准").when(c.startswith("Q"), "企业标准").otherwise("")


def detect_industry(code: Column) -> Column:
    return _prefixed(F.trim(F.replace(text(code), F.lit("/"), F.lit(""))), lambda _, industry: industry).otherwise("")


def detect_nature(code: Column) -> Column:
    c = F.trim(F.replace(text(code), F.lit("/"), F.lit("")))
    letters = F.regexp_extract(c, "^([A-Za-z]+)", 1)
    soft = text(code).rlike(r"^T\s*/") | c.rlike(r"^T($|\s|\d)") | c.startswith("YZ") | letters.isin(*RECOMMENDED) | text(code).contains("/T") & (letters != "")
    return F.when((c == "") | c.startswith("Q"), "").when(soft, "推荐性").otherwise("强制性")


def duplicate_code_key(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(normalize_spec_code(c)), "[^0-9A-Z]", "")


def _compatible(c: Column) -> Column:
    """Compatibility forms folded (NFKC), which no built-in function does."""
    return F.pandas_udf(_folded, StringType())(c)


def _folded(t: pd.Series) -> pd.Series:
    return t.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def duplicate_title_key(c: Column | str) -> Column:
    """Compatibility forms folded, lower case, no white space, and thrice no version bracket or edge punctuation."""
    t = F.regexp_replace(F.lower(_compatible(text(c))), "[\\s\u00a0\u3000]+", "")
    for _ in range(3):
        t = F.regexp_replace(F.regexp_replace(t, TITLE_VERSION, ""), f"^[{TITLE_EDGE}]+|[{TITLE_EDGE}]+$", "")
    return t


def parse_filename(name: Column | str) -> Column:
    """(code, title, matched) of a file name like `GB/T 50010-2010 title.pdf`.

    Noise words and ordinals before the code go, noise words and bare numbers in brackets behind the title.
    """
    raw = strip(text(name))
    t = strip(F.when(raw.contains("."), F.regexp_extract(raw, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(raw))
    wide = [chr(x + i) for x, n in ((0xFF10, 10), (0xFF21, 26), (0xFF41, 26)) for i in range(n)]
    t = F.translate(t, "".join(wide) + "／＿\u3000" + DASHES, "".join(chr(ord(x) - 0xFEE0) for x in wide) + "/_ " + "-" * len(DASHES))
    for _ in range(5):
        t = F.regexp_replace(t, "(?i)^(?:" + "|".join(NOISE_WORDS) + r")[\s_\-]*", "")
        t = F.ltrim(F.regexp_replace(t, r"^(?:\s*\d{1,3}\s*[.、)）](?!\d)\s*)+", ""))
    at = lambda i: F.regexp_extract(t, r"^([A-Za-z]{1,5})(/[A-Za-z]{1,4})?[\s\-_]*(\d{1,5}(?:\.\d+)?)[\s\-_]*(\d{4})?[\s_\-]*(.*)$", i)
    prefix, slash, number, year = F.upper(at(1)), at(2), at(3), at(4)
    trimmed = lambda x: F.regexp_replace(x, r"^[\- _.]+|[\- _.]+$", "")
    title = trimmed(at(5))
    for _ in range(5):
        title = trimmed(F.regexp_replace(title, r"(?i)(?:[（(]\s*\d{1,3}\s*[）)]|" + "|".join(TAIL_NOISE_WORDS) + ")$", ""))
    ok = prefix.isin(*CODE_PREFIXES) & ~(prefix.isin("Q", "T") & (slash == "") & (F.length(number) < 2)) & ~title.rlike("^[/_-]") & ~((title == "") & (year == ""))
    code = normalize_spec_code(F.concat(prefix, slash, F.lit(" "), number, F.when(year != "", F.concat(F.lit("-"), year)).otherwise("")))
    return F.struct(F.when(ok, code).otherwise("").alias("code"), F.when(ok, title).otherwise("").alias("title"), ok.alias("matched"))


def logger_category(c: Column | str) -> Column:
    """The category of a logger name: routes by their file, packages by their name, `app` for the rest."""
    t = text(c)
    route = F.regexp_extract(t, r"^app\.routes\.(\w+?)_routes", 1)
    package = F.regexp_extract(t, r"^app\.(ai|search|qa|ocr|parser|classifier|lexicon|maintenance|params)(?:\.|$)", 1)
    return F.when(route != "", route).when(package != "", package).otherwise("app")


def log_level(c: Column | str) -> Column:
    return F.when(F.upper(text(c)) == "WARNING", "WARN").otherwise(F.upper(text(c)))
