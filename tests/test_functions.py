"""Text functions on literals."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import labels, normative as N


def values(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i")
    plain = lambda v: v.asDict() if hasattr(v, "asDict") else v
    return [plain(r["v"]) for r in rows.collect()]


def test_normalize(spark):
    assert values(spark, N.normalize_text, "　大 坝\t安全　A  b ", "", None, "第 1 章") == ["大坝安全 A b", "", None, "第 1 章"]


def test_titles(spark):
    got = values(spark, N.title_info, "1 总则", "1.2 术语", "1.2.3 条文", "附录A 术语", "附录Ｂ", "说明", "2 规定如下：")
    assert [g and (g["node_type"], g["ref"], g["title"]) for g in got] == [("chapter", "1", "总则"), ("section", "1.2", "术语"), None, ("appendix", "A", "术语"), ("appendix", "Ｂ", "附录Ｂ"), None, ("chapter", "2", "规定如下：")]


def test_modality_and_parts(spark):
    assert values(spark, N.modality, "不得使用", "当水位超限时应报警", "应当检查", "宜采用", "可采用", "说明") == ["forbidden", "conditional", "must", "should", "may", None]
    assert values(spark, N.subject, "大坝应当检查。", "应检查", "说明", "甲：必须报告") == ["大坝", None, None, "甲"]
    assert values(spark, N.action, "大坝应当检查。", "说明 ", "报告应") == ["检查", "说明", "报告应"]
    assert values(spark, N.applicability, "对于土石坝，应监测。", "监测") == ["对于土石坝", None]
    assert values(spark, N.evidence, "监测", "说明") == [["监测资料", "监测报告", "监测记录"], ["相关说明资料"]]


def test_citations(spark):
    got = values(spark, N.citations, "符合 GB 50201-2014 和 SL 258-2017、GB/T 123；GB 50201-2014", "按GB 50201执行", "无")
    assert got == [["GB50201-2014", "SL258-2017", "GB/T123"], [], []]  # a code right after a CJK character is none


def test_sentences(spark):
    assert values(spark, N.sentences, "5.1.1 大坝应检查；记录。\n坝体应监测。", "短句") == [["大坝应检查；记录。", "坝体应监测。"], ["短句"]]


def test_item_requirement(spark):
    f = lambda intro: (lambda c: N.item_requirement(F.lit(intro), c))
    assert values(spark, f("5.1.1 报告应包括下列内容："), "监测资料；", "1 工程概况。") == ["报告应包括监测资料。", "报告应包括工程概况。"]
    assert values(spark, f("5.1.2 检查应遵守下列规定："), "按期进行；") == ["检查应遵守：按期进行。"]
    assert values(spark, f("5.1.3 规定如下："), "应报告；") == ["应报告。"]


def test_uids_and_labels(spark):
    import hashlib

    assert values(spark, N.concept_uid, "监测") == ["concept:" + hashlib.sha1("监测".encode()).hexdigest()[:12]]
    assert values(spark, lambda c: N.edge_uid(F.lit("NEXT"), c, F.lit("b")), "a") == ["edge:" + hashlib.sha1(b"NEXT|a|b").hexdigest()[:16]]
    assert values(spark, labels.search_form, "  A　 b ", None) == ["a b", ""]
    assert values(spark, lambda c: labels.natural_key(c, F.lit("x"))["key"], "5.10-2", "A.1", "5.2") == ["000005.000010.000002", "x", "000005.000002"]
    assert values(spark, lambda c: F.length(labels.excerpt(c)), "a" * 180, "a" * 181) == [180, 183]
    assert values(spark, N.table_ref, "表 5.3.9-1 系数", "无") == ["5.3.9-1", None]
    assert values(spark, lambda c: N.clamp(c, 0.82), "0.5", "7", "x", None) == [0.5, 1.0, 0.82, 0.82]
    assert N.register(spark) and spark.sql("SELECT gl_edge_uid('NEXT', 'a', 'b') AS v").first()["v"].startswith("edge:")


@pytest.mark.parametrize("continued,appendix,blocks,want", [(False, False, 1, 0.95), (True, False, 7, 0.82), (True, True, 9, 0.78)])
def test_confidence(spark, continued, appendix, blocks, want):
    assert values(spark, lambda _: N.segmentation_confidence(F.lit(continued), F.lit(appendix), F.lit(blocks)), "x") == [want]
