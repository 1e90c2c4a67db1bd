"""Requests for decisions on titles, what comes back, agreement with the heuristics; functions of SQL; scopes and descriptors."""

import json

from pyspark.sql import functions as F

from graphloom.functions import normative as N
from graphloom.functions import sql
from graphloom.operators import compare, graph, jobs, payloads, requirements, titles
from graphloom.operators.adjacency import store


def test_tails_reach_into_every_batch_that_begins_soon_after(spark):
    rows = spark.range(1, 24).select(F.lit("d").alias("doc"), F.col("id").alias("title_index"))
    got = {}
    for r in titles.with_tails(rows, 3, 7).collect():
        got.setdefault(r["batch"], ([], []))[0 if r["own"] else 1].append(r["title_index"])
    for batch in range(8):
        own, tail = got[batch]
        assert sorted(own) == [i for i in range(1, 24) if (i - 1) // 3 == batch]
        assert sorted(tail) == list(range(1, 24))[max(0, batch * 3 - 7) : batch * 3]


def test_standard_requests_hold_titles_and_earlier_labels(spark):
    rows = [("s", i, i, f"t{i}", f"标题{i}", None if i == 1 else f"标题{i - 1}", "chapter" if i < 14 else None) for i in range(1, 15)]
    found = spark.createDataFrame(rows, "standard_uid string, index int, page_idx int, title_id string, text string, prev_title string, label string")
    found = found.withColumns({"text_normalized": F.col("text"), "raw_title_level": F.lit(None).cast("int"), "next_title": F.lit(None).cast("string"), "prev_preview": F.lit("a"), "next_preview": F.lit(None).cast("string")})
    first, second = [json.loads(r["payload"]) for r in titles.standard_requests(found).orderBy("batch").collect()]
    assert first["previous_batch_tail"] == [] and [t["title_id"] for t in first["current_titles"]] == [f"t{i}" for i in range(1, 13)]
    assert second["previous_batch_tail"] == [{"title_id": f"t{i}", "page_idx": i, "text": f"标题{i}", "label": "chapter"} for i in range(9, 13)]
    assert second["current_titles"][1] == {
        "title_id": "t14", "title_index": 14, "page_idx": 14, "text": "标题14", "text_normalized": "标题14", "raw_title_level": None, "previous_title": "标题13", "next_title": None,
        "previous_block_preview": "a", "next_block_preview": None,
    }


def test_baselines_and_rates(spark):
    structure = spark.createDataFrame([("s", 1, "b1", "Chapter ", "1", "引用 标准"), ("s", 3, "b3", "section", "1.1", "x"), ("s", 4, "b3", "chapter", "2", "y"), ("s", 5, None, "chapter", "3", "z")], "standard_uid string, pos int, block_id string, node_type string, ref string, title string")
    clauses = spark.createDataFrame([("s", 6, ["b6", "b7"], "1.1.1", "c"), ("s", 7, ["b1"], "1.1.2", "d"), ("s", 8, [], "1.1.3", "e")], "standard_uid string, pos int, source_block_ids array<string>, clause_ref string, source_text_normalized string")
    base = titles.baseline_labels(structure, clauses)
    assert {r["block_id"]: (r["baseline_label"], r["baseline_source"], r["baseline_ref"]) for r in base.collect()} == {
        "b1": ("reference_standard", "normalized_structure", "1"), "b3": ("chapter", "normalized_structure", "2"), "b6": ("clause", "clauses", "1.1.1")}
    asked = spark.createDataFrame([("s", b, 1, t, t) for b, t in [("b1", "a"), ("b3", "y 12 "), ("b6", "c"), ("b9", "z")]], "standard_uid string, title_id string, page_idx int, text string, text_normalized string")
    said = spark.createDataFrame([("s", "b1", "reference_standard"), ("s", "b3", "none"), ("s", "b6", "section"), ("s", "b9", "none")], "standard_uid string, title_id string, label string").withColumns({"confidence": F.lit(0.5), "rationale": F.lit("")})
    rows = titles.evaluated(asked, base, said)
    assert titles.rates(rows).first().asDict() == {"titles": 4, "exact_matches": 2, "exact_match_rate": 0.5, "chapter_to_reference_standard": 0, "heading_to_none_with_page_suffix": 1}
    assert {r["title_id"] for r in titles.mismatches(rows).collect()} == {"b3", "b6"}
    assert titles.rates(rows.where("false")).first()["exact_match_rate"] == 0.0


def test_drifted_title_decisions(spark):
    texts = ['{"items": [{"title_id": "a", "label": " Clause ", "confidence": true}, {"title_id": "", "label": "clause"}, 3]}', '{"data": {"titles": [{"title_id": "b", "category": "none", "confidence": -1}]}}', '{"c": "chapter", "d": {"label": "section", "confidence": 0.3, "rationale": " r "}, "e": 5, "f": "odd"}', "[]", "7", "{", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, payload string")
    got = {(r["k"], r["title_id"], r["label"], r["confidence"], r["rationale"]) for r in payloads.title_items(rows, "k").collect()}
    assert got == {(0, "a", "clause", 1.0, ""), (1, "b", "none", 0.0, ""), (2, "c", "chapter", 0.0, ""), (2, "d", "section", 0.3, "r")}


def test_report_roles_and_plans_that_end_at_a_short_batch(spark):
    rows = spark.createDataFrame([(1, '{"items": [], "results": [{"title_id": "t", "role": "Topic", "ref": " ", "confidence": "1"}, {"title_id": "u", "role": "?"}]}'), (2, "7"), (3, None)], "k int, payload string")
    assert [tuple(r) for r in payloads.report_title_items(rows, "k").collect()] == [(1, "t", "topic", 4, False, None, None, None)]
    asked = spark.createDataFrame([("d", b, f"t{b}{i}") for b in range(4) for i in range(3)] + [("e", 0, "x")], "doc string, batch int, title_id string")
    counts = asked.groupBy("doc", "batch").agg(F.count("*").alias("n"))
    answers = asked.where("title_id NOT IN ('t11', 't30')").select("doc", "title_id")
    got = {r["doc"]: tuple(r)[1:] for r in payloads.plan_metrics(asked, counts, answers.unionByName(answers), "doc").collect()}
    assert got == {"d": (12, 4, 1, 3, 1), "e": (1, 1, 0, 1, None)}


def test_sql_functions_equal_the_column_functions(spark):
    assert {"gl_requirements", "gl_sentences", "gl_edge_uid"} <= set(sql.register(spark))
    rows = [
        (1, "4.1.2 大坝应包括下列内容：\n1）监测资料应符合 GB 50000-2016；", ["监测资料应符合 GB 50000-2016；", "2）报告"]), (2, "对于大型土石坝，应进行 SL 258-2017 计算。不得省略；短句。 x", []),
        (3, None, None), (4, "", []), (5, "检查应遵守下列规定：", ["(3) 记录。"]), (6, "一般说明", ["a"]), (7, "宜包括以下：", ["甲；"]), (8, "　大坝 应 　安全\n可　行  GB/T 1-99、GB/T 1-99", []),
    ]
    d = spark.createDataFrame(rows, "id int, t string, items array<string>")
    d.createOrReplaceTempView("gl_rows")
    t = F.col("t")
    scalar = spark.sql("SELECT id, gl_normalize(t), gl_modality(t), gl_subject(t), gl_action(t), gl_citations(t) FROM gl_rows").collect()
    assert [tuple(r) for r in scalar] == [tuple(r) for r in d.select("id", N.normalize_text(t), N.modality(t), N.subject(t), N.action(t), N.citations(t)).collect()]
    split = d.select("id", F.posexplode(N.sentences(t)))
    assert {tuple(r) for r in spark.sql("SELECT id, s.* FROM gl_rows, LATERAL gl_sentences(t) s").collect()} == {tuple(r) for r in split.collect()}
    as_items = F.transform("items", lambda x: F.struct(x.alias("text_normalized")))
    clauses = d.select(F.lit("s").alias("standard_uid"), F.col("id").alias("pos"), F.col("id").cast("string").alias("clause_uid"), t.alias("source_text_normalized"), as_items.alias("list_items"), F.lit("1").alias("clause_ref"), F.array().cast("array<string>").alias("heading_path"), F.lit(0.9).alias("segmentation_confidence"))
    want = {(int(r["parent_clause_uid"]), r["ordinal"], r["requirement_text"], r["modality"]) for r in requirements.requirements(clauses).collect()}
    got = spark.sql("SELECT id, r.* FROM gl_rows, LATERAL gl_requirements(t, items) r")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_scope_requests_by_step(spark):
    units = spark.createDataFrame([("s", "u1", "t", ["p"], [], "text", [1, 2]), ("s", "u2", None, None, None, None, None), ("x", "u3", "t", [], [], "text", [1, 1])], "standard_uid string, unit_uid string, title string, section_path array<string>, structural_path array<string>, text string, page_span array<int>")
    levels = {
        "chapters": spark.createDataFrame([("s", "c1", "一"), ("s", "c2", "二")], "standard_uid string, id string, label string"),
        "sections": spark.createDataFrame([("s", "s1", "c1", "甲", "section")], "standard_uid string, id string, chapter_id string, label string, scope_type string"),
        "clauses": spark.createDataFrame([("s", "k1", "s1", "c1", "k"), ("s", "k2", "s1", "c1", "l")], "standard_uid string, id string, section_id string, chapter_id string, label string"),
    }
    read = lambda made: {r["unit_uid"]: json.loads(r["payload"]) for r in made.collect()}
    first = read(compare.scope_requests(units, levels))
    assert set(first) == {"u1", "u2"} and first["u1"]["candidate_chapters"] == [{"id": "c1", "label": "一"}, {"id": "c2", "label": "二"}]
    assert first["u1"]["report_unit"] == {"unit_uid": "u1", "title": "t", "section_path": ["p"], "structural_path": [], "text": "text", "page_span": [1, 2]}
    chosen = spark.createDataFrame([("s", "u1", "c1"), ("s", "u1", "c1"), ("s", "u2", "c2")], "standard_uid string, unit_uid string, chapter_id string")
    second = read(compare.scope_requests(units, levels, chosen))
    assert set(second) == {"u1"} and [c["id"] for c in second["u1"]["selected_chapters"]] == ["c1"] and second["u1"]["candidate_sections"] == [{"id": "s1", "chapter_id": "c1", "label": "甲", "scope_type": "section"}]
    sections = spark.createDataFrame([("s", "u1", "s1"), ("s", "u2", "s1")], "standard_uid string, unit_uid string, section_id string")
    third = read(compare.scope_requests(units, levels, chosen, sections))
    assert [c["id"] for c in third["u1"]["candidate_clauses"]] == ["k1", "k2"] and [c["id"] for c in third["u2"]["selected_chapters"]] == ["c2"]


def test_descriptors_of_requests(spark):
    registry = spark.createDataFrame([("sl258:2017", "d1", "SL258", "名"), ("gb1:99", "d1", "GB1", "b")], "standard_id string, document_id string, code string, title string")
    asked = spark.createDataFrame([(1, " SL258:2017 ", "a.pdf"), (2, "gb7:2001", "x/国标.v2.pdf"), (3, "odd", "SL 9-2001.pdf"), (4, None, "12_SL 9-2001 表.pdf"), (5, "", "none.pdf")], "k int, standard_id string, name string")
    got = {r["k"]: (r["source"], r["found_id"], r["code"], r["title"]) for r in jobs.described(asked, registry).collect()}
    assert got == {1: ("registry", "sl258:2017", "SL258", "名"), 2: ("id", "gb7:2001", "GB7", "国标.v2"), 3: (None, None, None, None), 4: ("name", "sl9:2001", "SL9", "SL 9-2001 表"), 5: (None, None, None, None)}
    assert [tuple(r) for r in jobs.by_document(registry, spark.createDataFrame([("d1",), ("d2",)], "document_id string")).collect()] == [("d1", "gb1:99", "GB1", "b")]
    folders = spark.createDataFrame([("SL258-2017",), ("my-space",)], "f string").select(N.space_descriptor(F.col("f")).alias("d")).select("d.*")
    assert [tuple(r) for r in folders.collect()] == [("sl258:2017", "SL258"), ("my-space", "MYSPACE")]


def test_typed_neighborhood_keeps_its_start_and_its_focus(spark):
    nodes = spark.createDataFrame([("g", n, "standard" if n == "r" else "a" if n != "h" else "b", n, None) for n in "rpqsth"], "standard_uid string, node_uid string, node_type string, label string, text_content string")
    ends = [("r", "p"), ("r", "q"), ("r", "s"), ("r", "h"), ("p", "t"), ("t", "r"), ("h", "t"), ("p", "q")]
    edges = spark.createDataFrame([("g", f"e{i}", "X", a, b) for i, (a, b) in enumerate(ends)], "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string")
    for chunk in (1, 100):
        stored = store(nodes, edges, chunk)
        found = graph.typed_neighborhood(stored, nodes.where("node_uid = 'r'"), ["a"], ["X"], 2, 2, 1)
        # degrees r 5, p 3, t 3, q 2, h 2, s 1: r passes on to p and t; p to r and t, t to r and p
        assert {(r["node_uid"], r["level"], r["focus"]) for r in found.collect()} == {("r", 0, True), ("p", 1, True), ("t", 1, False)}
        assert {r["edge_uid"] for r in graph.edges_among(stored, found, ["X"]).collect()} == {"e0", "e4", "e5"}


def test_units_of_one_choice_share_their_lists(spark):
    units = spark.createDataFrame([("s", f"u{i}", "t", ["p"], [], "text", [1, 2]) for i in range(5)], "standard_uid string, unit_uid string, title string, section_path array<string>, structural_path array<string>, text string, page_span array<int>")
    levels = {
        "chapters": spark.createDataFrame([("s", "c1", "一"), ("s", "c2", "二")], "standard_uid string, id string, label string"),
        "sections": spark.createDataFrame([("s", f"s{i}", f"c{i % 2 + 1}", "甲", "section") for i in range(6)], "standard_uid string, id string, chapter_id string, label string, scope_type string"),
    }
    chosen = spark.createDataFrame([("s", f"u{i}", f"c{i % 2 + 1}") for i in range(4)] + [("s", "u4", "c1"), ("s", "u4", "c2")], "standard_uid string, unit_uid string, chapter_id string")
    members, bodies = compare.scope_bodies(units, levels, chosen, None, ())
    assert members.count() == 5 and bodies.count() == 3  # once a choice, not once a unit
    got = {r["unit_uid"]: (r["candidates"], json.loads(r["payload"])) for r in compare.scope_requests(units, levels, chosen).collect()}
    assert {u: n for u, (n, _) in got.items()} == {"u0": 3, "u1": 3, "u2": 3, "u3": 3, "u4": 6}
    assert got["u1"][1]["report_unit"]["unit_uid"] == "u1" and [c["id"] for c in got["u1"][1]["candidate_sections"]] == ["s1", "s3", "s5"] and len(got["u4"][1]["selected_chapters"]) == 2
