"""Outline of standards: goldens, and window functions against a sequential reading."""

import random
import re

from graphloom.operators import graph_build, outline, requirements

BLOCKS = "standard_uid string, page_idx int, block_idx int, item_idx int, source_type string, text string"


def read(blocks):
    """A plain sequential reading with heuristic titles: clause refs with their chapter and section, accepted titles, orphans."""
    chapter = section = appendix = clause = None
    body, out, accepted, orphans = "front_matter", [], [], 0
    for i, (kind, text) in enumerate(blocks):
        following = blocks[i + 1] if i + 1 < len(blocks) else None
        info = None
        if kind == "title":
            if m := re.match(r"附录([A-Z])", text):
                info = ("appendix", m[1])
            elif m := re.match(r"(\d+\.\d+)\s+\S", text):
                info = ("section", m[1])
            elif m := re.match(r"(\d+)\s+\S", text):
                info = ("chapter", m[1])
        ok = info is not None
        if ok and info[0] == "chapter" and clause:
            number, now = int(info[1]), int(clause["ref"].split(".")[0])
            inline = text.endswith("：") or "如下" in text or bool(following and (following[0] == "table" or re.match(r"\d+）|\d+\.(?!\d)|\(?\d+\)?(\s|$)", following[1]) or following[1].startswith("表")))
            ok = not (number < now or (number != now and inline))
        if ok:
            clause = None
            accepted.append(i)
            if info[0] == "appendix":
                body, appendix, chapter, section = "appendix", info[1], None, None
            elif info[0] == "chapter":
                body, chapter, section = ("appendix" if body == "appendix" else "main"), info[1], None
            else:
                section = info[1]
            continue
        if not info and (m := re.match(r"(\d+\.\d+\.\d+)", text)):
            clause = {"ref": m[1], "body": body, "chapter": chapter, "section": section, "blocks": 1}
            out.append(clause)
        elif clause is None:
            orphans += 1
        else:
            clause["blocks"] += 1
    return out, accepted, orphans


def test_windows_read_like_a_reader(spark):
    rng = random.Random(31)
    pool = [("title", "1 总则"), ("title", "2 规定"), ("title", "3 要求如下："), ("title", "2.1 节"), ("title", "3.2 节"), ("title", "附录A 术语"), ("title", "前言"), ("paragraph", "2.1.1 应检查。"), ("paragraph", "3.1.2 宜检查。"), ("paragraph", "1.1.1 可检查。"), ("paragraph", "说明"), ("list_item", "1）应监测；"), ("table", "表 1 特性"), ("paragraph", "2）应记录")]
    rows, want = [], {}
    for d in range(120):
        blocks = [rng.choice(pool) for _ in range(rng.randint(1, 25))]
        want[f"d{d}"] = read(blocks)
        rows += [(f"d{d}", 1, i + 1, 0, k, t) for i, (k, t) in enumerate(blocks)]
    got = outline.outline(outline.with_decisions(outline.normalized_blocks(spark.createDataFrame(rows, BLOCKS)))).cache()
    clauses, accepted, orphans = {}, {}, {}
    for r in outline.clauses(got).orderBy("standard_uid", "pos").collect():
        clauses.setdefault(r["standard_uid"], []).append({"ref": r["clause_ref"], "body": r["body_kind"], "chapter": r["chapter_ref"], "section": r["section_ref"], "blocks": len(r["source_block_ids"])})
    for r in got.where("accepted").orderBy("standard_uid", "pos").collect():
        accepted.setdefault(r["standard_uid"], []).append(r["pos"] - 1)
    for r in outline.standard_metrics(got, outline.clauses(got)).collect():
        orphans[r["standard_uid"]] = r["orphans"]
    for d, (c, a, o) in want.items():
        assert clauses.get(d, []) == c and accepted.get(d, []) == a and orphans[d] == o, d


def test_decided_titles(spark):
    blocks = [("1 总则", "chapter"), ("1.0.1 为保证", "clause"), ("2 规范性引用文件", "reference_standard"), ("2.0.1 下列文件", "clause"), ("附录A 术语", "appendix")]
    table = spark.createDataFrame([("s", 1, i + 1, 0, "title", t) for i, (t, _) in enumerate(blocks)], BLOCKS)
    decided = spark.createDataFrame([("s", f"p001-b{i + 1:03d}", label) for i, (_, label) in enumerate(blocks)], "standard_uid string, title_id string, label string")
    rows = outline.outline(outline.with_decisions(outline.normalized_blocks(table), decided))
    assert [(r["clause_uid"], r["chapter_ref"]) for r in outline.clauses(rows).orderBy("pos").collect()] == [("s:main:1.0.1", "1"), ("s:main:2.0.1", "2")]
    assert [r["node_type"] for r in outline.structure_nodes(rows).orderBy("pos").collect()] == ["chapter", "reference_standard", "appendix"]


def test_inline_title_and_tables(spark):
    blocks = [("title", "5 安全"), ("title", "5.3 稳定"), ("paragraph", "5.3.9 坝坡应进行计算，规定如下："), ("title", "3 抗滑稳定安全系数规定如下："), ("list_item", "1）应采用表列值；"), ("table", "表 5.3.9-1 系数"), ("list_item", "2）应复核；"), ("table", "表 5.3.9-2 系数"), ("paragraph", "5.3.10 应报告。")]
    table = spark.createDataFrame([("s", 1, i + 1, 0, k, t) for i, (k, t) in enumerate(blocks)], BLOCKS)
    rows = outline.outline(outline.with_decisions(outline.normalized_blocks(table)))
    found = outline.clauses(rows).cache()
    first, second = found.orderBy("pos").collect()
    assert [t["table_ref"] for t in first["tables"]] == ["5.3.9-1", "5.3.9-2"] and len(first["list_items"]) == 2 and second["chapter_ref"] == "5"
    asked = requirements.requirements(found)
    assert asked.where("parent_clause_uid LIKE '%5.3.9'").count() == 2
    nodes = graph_build.standard_nodes(outline.structure_nodes(rows), found, asked)
    assert {r["node_type"]: r["count"] for r in nodes.groupBy("node_type").count().collect()}["table"] == 2
    edges = graph_build.standard_edges(outline.structure_nodes(rows), found, asked)
    assert edges.count() == edges.select("edge_uid").distinct().count()
