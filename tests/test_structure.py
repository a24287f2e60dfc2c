"""Headings and clauses of small texts, row by row."""

import pytest

from clausespark.operators import structure as S


def clauses(spark, md, **kw):
    lines = S.to_lines(spark.createDataFrame([(1, md)], "doc_id long, text string"))
    return [tuple(r) for r in S.clause_table(lines, **kw).orderBy("line").select("no", "title", "content", "path", "is_non").collect()]


def candidates(spark, md):
    lines = S.to_lines(spark.createDataFrame([(1, md)], "doc_id long, text string"))
    return [(r.no, r.tail, r.level) for r in S.candidates(lines).where("no is not null").orderBy("line").collect()]


def test_whole_document(spark):
    md = """# 前言
本规范由部门组织编制。
## 第3页
封底文字
# 1 总则
1.0.1 为加强质量管理,制定本规范。
## 5.4 检验标准
主控项目
# 2 本规范用词说明
2.1 表示很严格的用词采用必须。
## 附录A 验收表
A.1.2 验收时应填写下表的各项内容。
A. 1.3 记录
条文说明
# 1 总则
1.0.1 说明的文字。"""
    assert clauses(spark, md) == [
        ("前言", "前言", "本规范由部门组织编制。", "", True),
        ("第3页", "第3页", "封底文字", "", True),
        ("1.0.1", "", "为加强质量管理,制定本规范。", "1 总则", False),
        ("5.4", "检验标准", "主控项目", "1 总则", True),
        ("2.1", "", "表示很严格的用词采用必须。", "", True),
        ("A.1.2", "", "验收时应填写下表的各项内容。", "附录A 验收表", False),
        ("A.1.3", "", "记录\n条文说明", "附录A 验收表", False),
        ("1.0.1", "", "说明的文字。", "", True),
    ]


def test_commentary_behind_a_prefix_repeats_numbers(spark):
    md = "# 3 基本规定\n3.0.1 正文应当如此规定。\n附：条文说明\n# 3 基本规定\n3.0.1 本条说明正文的来由。"
    got = clauses(spark, md)
    assert [(no, non) for no, _, _, _, non in got] == [("3.0.1", False), ("3.0.1", True)]
    assert got[0][2] == "正文应当如此规定。\n附：条文说明"


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("# 1 总则\n3.0 占位\n3.0.1 条文的内容", [("1", "总则", 1), ("3.0.1", "条文的内容", 3)]),
        ("#### 4.2.1\n说明文字", [("4.2.1", "", 3)]),
        ("#### 7\n文字", []),
        ("前文。\n3.1\n术语", [("3.1", "", 2)]),
        ("引用第\n3.1\n条", []),
        ("3.1\n开篇", []),
        ("2020-04-23 发布\n2008 年修订\n0.95 系数\n1 钢筋\n1.1 plain words", []),
        ("6.11 导流工程……28\n6.12 工程.....28", []),
        ("# 2008\n# 2008 年鉴\n# 3 偏差应符合规定。", []),
        ("# Introduction\n# 引用标准名录\n## 关于发布规范的公告", [("引用标准名录", "引用标准名录", 1), ("关于发布规范的公告", "关于发布规范的公告", 1)]),
        ("M. O. 2 垂直度", [("M.0.2", "垂直度", 3)]),
        ("GB 5768 的本部分\nHPB235 钢筋", []),
        ("附录 B.1 试验方法", [("附录B.1", "试验方法", 2)]),
        ("1．2 总　则", [("1.2", "总　则", 2)]),
        ("## 1.1 总    则", [("1.1", "总则", 2)]),
        ("1.2.3.4.5.6.7.8 深层条文", [("1.2.3.4.5.6.7.8", "深层条文", 6)]),
        ("####### 1.1 七个井号", []),
    ],
)
def test_candidates(spark, md, want):
    assert candidates(spark, md) == want


def test_chapters_grow_and_numbers_come_once(spark):
    md = "# 7 末章\n7.1.1 甲方的条文内容足够长以至于不是标题吧对的。\n# 2 变形测量标距\n7.1.1 条和有关规定的下半行\n# 8 新章\n8.0.1 乙方的条文内容足够长以至于不是标题吧对的。"
    got = clauses(spark, md)
    assert [no for no, *_ in got] == ["7.1.1", "8.0.1"]
    assert got[0][2].endswith("2 变形测量标距\n7.1.1 条和有关规定的下半行")


def test_contents_pages_swallow_and_head_blocks_stay(spark):
    assert clauses(spark, "目次\n1 总则 1\n# 1 总则\n1.0.1 条文的内容很重要。") == [("1.0.1", "", "条文的内容很重要。", "1 总则", False)]
    got = clauses(spark, "1\n封面文字\n# 1 总则\n1.0.1 条文的内容很重要。\n# 目次\n1.0.2 又一条文的内容。\n裸行\n## 9.1 目  次\n丢弃")
    assert got[0] == ("~1", "1", "1\n封面文字", "", True)
    assert [(no, c) for no, _, c, _, _ in got[1:]] == [("1.0.1", "条文的内容很重要。"), ("1.0.2", "又一条文的内容。\n裸行")]
    assert clauses(spark, "没有标题\n只有文字") == []


def test_titles_by_vote_and_labels(spark):
    md = "# 4 材料\n4.1 水泥\n内容一\n4.2 砂\nⅠ 主控项目\n一般项目\n4.3 这一条是很长的句子而且超过了二十个字所以不会是标题\n# 5 其他\n5.1 短句。"
    got = {no: (t, c, non) for no, t, c, _, non in clauses(spark, md)}
    assert got["4.1"] == ("水泥", "内容一", False) and got["4.2"] == ("砂", "Ⅰ 主控项目\n一般项目", True)
    assert got["4.3"][0] == "" and got["5.1"] == ("", "短句。", False)


def test_untitled_rows_behind_notes_are_notes(spark):
    md = "# 前言\n前言文字\n1.1 编制单位的名称及负责人,以及参加编制的人员名单。\n# 1 总则\n1.0.1 条文的内容很重要。"
    assert [(no, non) for no, _, _, _, non in clauses(spark, md)] == [("前言", True), ("1.1", True), ("1.0.1", False)]
    assert all(not path.startswith("前言") for *_, path, _ in clauses(spark, md))
