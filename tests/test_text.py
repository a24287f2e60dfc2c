from pyspark.sql import functions as F

from clausespark.functions import text as T


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first().y


def test_plain_text(spark):
    x = F.col("x")
    assert one(spark, "<table><tr><td>a</td><td>b &amp; c</td></tr></table><p>d</p>", T.plain_text(x)) == "a b & c\nd"
    assert one(spark, "HRB400 N/mm2 $x^2$ end", T.plain_text(x)) == "HRB400 N/mm2 end"
    assert one(spark, None, T.plain_text(x)) == ""
    once = one(spark, "<div>1 &lt; 2</div>\n\n<br/>x", T.plain_text(x))
    assert one(spark, once, T.plain_text(x)) == once


def test_spacing_and_tokens(spark):
    x = F.col("x")
    assert one(spark, "1 总 则 > GB 50010", T.normalize_cjk_spacing(x)) == "1 总则 > GB 50010"
    assert one(spark, "GB50010混凝土 x甲", T.tokenize(x)) == ["gb50010", "混凝", "凝土", "x", "甲"]
    assert one(spark, "a\\n<table><tr>", T.normalize_md(x)) == 'a<br><table align="center"><tr>'


def test_chunks(spark):
    x = F.col("x")
    assert one(spark, "短正文。", T.chunks(x, 100)) == ["短正文。"]
    assert one(spark, "", T.chunks(x, 100)) == []
    got = one(spark, "甲" * 1000, T.chunks(x, 100))
    assert all(len(c) <= 100 for c in got) and "".join(got) == "甲" * 1000
    got = one(spark, "".join(f"第{i}句话。" for i in range(400)), T.chunks(x, 100))
    assert all(len(c) <= 100 and c.endswith("。") for c in got)
    overlaps = [max((n for n in range(1, 11) if b.startswith(a[-n:])), default=0) for a, b in zip(got, got[1:], strict=False)]
    assert max(overlaps) > 0


def test_codes(spark):
    x = F.col("x")
    assert one(spark, "GBT50010—2010", T.normalize_spec_code(x)) == "GB/T50010-2010"
    assert one(spark, "gb/t 50010 — 2010", T.duplicate_code_key(x)) == "GBT500102010"
    assert one(spark, "（2015年版）ＪＧＪ107 规范（2015年版）", T.duplicate_title_key(x)).endswith("jgj107规范")
    got = one(spark, "GB/T 50010-2010 混凝土结构设计规范.pdf", T.parse_filename(x))
    assert (got.code, got.title, got.matched) == ("GB/T 50010-2010", "混凝土结构设计规范", True)
    assert not one(spark, "T2塔楼施工方案.pdf", T.parse_filename(x)).matched
    assert one(spark, "Q/SY 1", T.detect_nature(x)) == "" and one(spark, "T/CECS 1", T.detect_hierarchy(x)) == "团体标准"


def test_character_references(spark):
    x = F.col("x")
    assert one(spark, "&#20013;&#x4e2d; &mdash; &amp;lt; &nosuch; &#128; &#0; a&b &lt", T.unescape(x)) == "中中 — &lt; &nosuch; € � a&b <"
    assert one(spark, "<p>&#20013;&nbsp;x</p>", T.strip_html(x)) == "中 x"


def test_names_with_noise(spark):
    x = F.col("x")

    def parse(name):
        r = one(spark, name, T.parse_filename(x))
        return (r.code, r.title, r.matched)

    assert parse("高清_GB 50010‑2010 混凝土结构设计规范电子版.pdf") == ("GB 50010-2010", "混凝土结构设计规范", True)
    assert parse("1. JGJ 107-2016 钢筋机械连接技术规程（1）副本.pdf") == ("JGJ 107-2016", "钢筋机械连接技术规程", True)
    assert parse("GB 50010—2010 混凝土结构设计规范（2015年版）.pdf")[1] == "混凝土结构设计规范（2015年版）"
    assert parse("GB 50204-2015 施工规范修正版.pdf")[1] == "施工规范修正版"
    assert parse("DB13/T 200.pdf")[2] is False and parse("Q1报表.xlsx")[2] is False
    assert one(spark, "ＪＧＪ１０７ 规程Ⅲ（2015年版）。", T.duplicate_title_key(x)) == "jgj107规程iii"


def test_spacing_of_rare_ideographs(spark):
    x = F.col("x")
    assert one(spark, "㐀 一\t豈\r\n中　国", T.normalize_cjk_spacing(x)) == "㐀一豈\r\n中国"


def test_statutory_titles_and_covers(spark):
    from clausespark.operators import structure as S

    x = F.col("x")
    yes = ["前言", "本规范用词说明", "本规程用词用语说明", "关于发布行业标准《城市桥梁工程施工与质量验收规范》的公告", "3.0.2 条文说明", "引用标准名录"]
    assert [one(spark, t, S.is_statutory(x)) for t in [*yes, "用词要求", "公告发布要求", "附录A", ""]] == [True] * 6 + [False] * 4
    assert one(spark, "ICS 77.140.60\n中国标准出版社 出版发行\n定价 20 元", S.is_cover(x)) and not one(spark, "本规范发布后实施。", S.is_cover(x))
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["# 6 工程", "6.11 导流工程……28", "6.1 应符合……的规定，见表", "6.2 总则.....3"])], "doc_id long, line int, text string")
    assert [r.no for r in S.candidates(lines).where("no is not null").orderBy("line").collect()] == ["6", "6.1"]


def test_references_as_browsers_read_them(spark):
    import html
    import random

    rng = random.Random(3)
    names = ["amp", "ampb", "notit;", "not", "lt;", "ltimes;", "copy", "copycat", "frac12", "frac12;", "nbsp", "unknown;", "CounterClockwiseContourIntegral;", "Aacute", "x", ""]
    digits = ["65", "000000000065;", "0", "13", "128;", "129", "1114112", "99999999999;", "x41;", "X0041", "x110000;", "xD800;", "11", "xFFFE;", "xfdd0", "127", "", "x"]
    texts = [f"&{n}" for n in names] + [f"&#{n}" for n in digits] + ["a & b", "&&amp;&", "&amp;lt;", "&\n;", "R&D;"]
    texts += ["".join(rng.choice(["&", "amp", ";", "#", "6", "5", "x4", " ", "lt", "not", "in;", "\u00e9"]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", T.unescape("t").alias("u")).collect()
    assert [(r.t, r.u) for r in got if r.u != html.unescape(r.t)] == []


def whole_fold(text, limit):
    ends = "\u3002\uff1b\uff01\uff1f.!?;"
    units, cur = [], ""
    for ch in text:
        cur += ch
        if ch in ends or len(cur) == limit:
            units.append(cur)
            cur = ""
    units += [cur] if cur else []
    out, buf = [], ""
    for u in units:
        if buf and len(buf) + len(u) > limit:
            out.append(buf)
            window = buf[max(0, len(buf) - limit // 10) :]
            at = max(window[:-1].rfind(c) for c in ends)
            tail = window[at + 1 :] if at >= 0 and limit // 10 else ""
            buf = tail if len(tail) + len(u) <= limit else ""
        buf += u
    return out + ([buf] if buf else [])


def test_chunks_against_a_plain_fold(spark):
    import random

    rng = random.Random(4)
    texts = ["", "short.", "x" * 1000, "a. " * 400, "\u53e5\u3002" * 700, "." * 300, "\U0001f600" * 250]
    texts += ["".join(rng.choice(["word ", "a", ". ", "!", "\u3002", "\n", "longer stretch of words "]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for limit in (40, 100, 512):
        got = {r.i: r.c for r in rows.select("i", T.chunks("t", limit).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == (whole_fold(t, limit) if len(t) > limit else [t] if t else []), (limit, i)
