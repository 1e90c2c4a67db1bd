"""Reports: the two-page golden, and units and outline against sequential readings."""

import json
import random

from graphloom.operators import report
from graphloom.sources import artifacts


def golden(tmp_path):
    text = lambda kind, t: {"type": kind, "bbox": [0, 0, 1, 1], "content": {f"{kind}_content": [{"type": "text", "content": t}], "level": 1}}
    second = []
    for i, t in enumerate(["1 总则", "1.1 编制依据", "1 收集图纸", "2 查勘河段", "2 水文条件", "2.1 流域概况"]):
        second.append(text("title", t))
        if i:
            second.append(text("paragraph", f"说明 {t}"))
    second.append({"type": "table", "bbox": [0, 0, 1, 1], "content": {"table_caption": [{"type": "text", "content": "表 2.1-1 径流特征表"}], "html": "<table><tr><td>径流量</td><td>1&amp;2</td></tr></table>"}})
    second.append({"type": "image", "bbox": [0, 0, 1, 1], "content": {"image_caption": [{"type": "text", "content": "图 2.1-1 水系示意图"}], "image_source": {"path": "images/a.jpg"}}})
    pages = [[text("title", "内容摘要"), text("paragraph", "本文说明")], second]
    folder = tmp_path / "r1"
    folder.mkdir()
    (folder / "content.json").write_text(json.dumps(pages, ensure_ascii=False))
    return str(tmp_path / "*" / "content.json")


def test_golden(spark, tmp_path):
    found = artifacts.read_artifacts(spark, golden(tmp_path))
    blocks = artifacts.report_blocks(found)
    refs = {r["source_type"]: r["item_ref"] for r in blocks.where("item_ref IS NOT NULL").collect()}
    assert refs == {"table": "2.1-1", "image": "2.1-1"}
    rows = report.page_roles(report.normalized(blocks)).cache()
    plan = report.title_plan(rows)
    kinds = [r["kind"] for r in plan.orderBy("pos").collect()]
    assert kinds == ["front_matter", "chapter", "section", "topic", "topic", "chapter", "section"]
    stacked = report.planned(rows, plan)
    sections = {r["title"]: r for r in report.sections(stacked).collect()}
    by_pos = {r["pos"]: t for t, r in sections.items()}
    assert by_pos[sections["1 收集图纸"]["parent_pos"]] == "1.1 编制依据" and len(sections) == 7
    units = report.text_units(stacked)
    assert units.count() >= 4
    table = blocks.where("source_type = 'table'").first()["text"]
    assert table == "表 2.1-1 径流特征表\n径流量 | 1&2"
    pos = plan.orderBy("pos").collect()[4]["pos"]
    decided = spark.createDataFrame([("r1", pos, "section", 2, None, True)], "document_id string, pos int, kind string, level int, ref string, structural boolean")
    over = report.override_plan(plan, decided)
    assert report.plan_source(over).first()["source"] == "hybrid" and over.where(f"pos = {pos}").first()["kind"] == "section"
    media = report.media(stacked)
    shown = {r["uid"]: (r["item_ref"], r["caption"], r["section_path"][-1]) for r in media.collect()}
    assert shown == {"report:r1:table:1": ("2.1-1", "表 2.1-1 径流特征表", "2.1 流域概况"), "report:r1:figure:1": ("2.1-1", "图 2.1-1 水系示意图", "2.1 流域概况")}
    nodes = {r["node_uid"]: r["label"] for r in report.report_nodes(report.sections(stacked), units, media).collect()}
    assert nodes["report:r1:figure:1"] == "图 2.1-1 水系示意图" and len(nodes) == 1 + 7 + units.count() + 2
    edges = report.report_edges(report.sections(stacked), units, media)
    assert edges.where("edge_type = 'CONTAINS'").count() == 7 + units.count() + 2


def test_units_and_outline_read_like_a_reader(spark):
    rng = random.Random(5)
    rows, want_units, want_paths = [], {}, {}
    for d in range(60):
        name, stack, buffer, units, paths = f"d{d}", [], [], [], []

        def flush():
            if buffer:
                if not stack:  # content before any title
                    stack.append((1, report.IMPLICIT))
                    paths.append([report.IMPLICIT])
                units.append("\n".join(buffer))
                buffer.clear()

        for i in range(rng.randint(1, 40)):
            kind = rng.choice(["title", "paragraph", "paragraph", "paragraph", "list_item"])
            text = f"{kind[0]}{i}" + "字" * rng.choice([1, 5, 300, 950])
            level = rng.randint(1, 5) if kind == "title" else None
            rows.append((name, i + 1, kind, text, level))
            if kind == "title":
                flush()
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, text))
                paths.append([t for _, t in stack])
            elif kind == "list_item":
                flush()
                buffer.append(text)
                flush()
            else:
                buffer.append(text)
                if sum(map(len, buffer)) >= 900 or len(buffer) >= 4:
                    flush()
        flush()
        want_units[name], want_paths[name] = units, paths
    table = spark.createDataFrame(rows, "document_id string, block_idx int, source_type string, text string, level int").selectExpr("*", "1 AS page_idx", "'body' AS page_role")
    normal = report.normalized(table)
    plan = normal.where("level IS NOT NULL").selectExpr("document_id", "pos", "'topic' AS kind", "level", "cast(null AS string) AS ref", "true AS structural")
    stacked = report.planned(normal.drop("level"), plan).cache()
    got = {}
    for r in report.text_units(stacked).orderBy("document_id", "nth").collect():
        got.setdefault(r["document_id"], []).append(r["text"])
    assert got == {d: u for d, u in want_units.items() if u}
    got = {}
    for r in report.sections(stacked).orderBy("document_id", "nth").collect():
        got.setdefault(r["document_id"], []).append(r["path"])
    assert got == {d: p for d, p in want_paths.items() if p}
