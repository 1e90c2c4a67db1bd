"""A build of reports moves its texts no more often than documents have to be dealt."""

from graphloom.operators import report


def plan_of(spark, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def blocks(spark):
    rows = [("d", 1, 1, "title", "目录"), ("d", 2, 2, "title", "1 概述"), ("d", 2, 3, "paragraph", "第一段。"), ("d", 2, 4, "title", "1.1 范围"), ("d", 2, 5, "list_item", "项"), ("d", 2, 6, "image", "图 1"), ("e", 1, 1, "paragraph", "前文。"), ("e", 1, 2, "title", "无号"), ("e", 1, 3, "paragraph", "后文。")]
    return spark.createDataFrame(rows, "document_id string, page_idx int, block_idx int, source_type string, text string")


def test_blocks_are_dealt_once(spark):
    roles = report.page_roles(report.normalized(blocks(spark)))
    assert not any("graphloom-steps" in f for f in roles.inputFiles()) and plan_of(spark, roles).count("Exchange") == 1
    ranged = report.page_roles(report.normalized(blocks(spark).repartitionByRange(3, "document_id")))
    assert plan_of(spark, ranged).count("Exchange") == 1 and sorted(map(tuple, ranged.collect())) == sorted(map(tuple, roles.collect()))
    assert {(r["document_id"], r["page_idx"], r["page_role"]) for r in roles.collect()} == {("d", 1, "toc"), ("d", 2, "body"), ("e", 1, "body")}


def test_plan_meets_blocks_without_a_second_move(spark):
    roles = report.page_roles(report.normalized(blocks(spark))).localCheckpoint()
    plan = report.title_plan(roles).localCheckpoint()
    stacked = report.planned(roles, plan)
    assert plan_of(spark, stacked).count("Exchange") == 1
    got = {(r["document_id"], r["pos"]): r for r in stacked.collect()}
    assert len(got) == roles.count() == 9
    assert {(r["document_id"], r["pos"]): (r["kind"], r["level"], r["ref"], r["structural"]) for r in plan.where("kind <> 'ignore'").collect()} == {k: (r["kind"], r["level"], r["ref"], r["structural"]) for k, r in got.items() if r["source_type"] == "title" and r["level"]}
    assert got["d", 3]["level"] is None and got["e", 1]["implicit"] and got["e", 1]["title"] == report.IMPLICIT


def test_nodes_of_units_do_not_move(spark):
    roles = report.page_roles(report.normalized(blocks(spark))).localCheckpoint()
    stacked = report.planned(roles, report.title_plan(roles)).localCheckpoint()
    found, units, media = report.sections(stacked).localCheckpoint(), report.text_units(stacked).localCheckpoint(), report.media(stacked).localCheckpoint()
    own = report.content_nodes(units, media)
    assert "Exchange" not in plan_of(spark, own) and own.count() == units.count() + media.count()
    both = report.outline_nodes(found, units, media).unionByName(own)
    assert sorted(map(str, both.collect())) == sorted(map(str, report.report_nodes(found, units, media).collect()))
