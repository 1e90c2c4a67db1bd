"""Small graphs, payloads, upserts and streams."""

import json

from pyspark.sql import functions as F

from graphloom.operators import compare, edits, graph, payloads
from graphloom.operators.adjacency import store
from graphloom.sources import artifacts
from graphloom.streaming import pipelines

NODES = "standard_uid string, node_uid string, node_type string, label string, text_content string"
EDGES = "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string"


def small(spark):
    nodes = spark.createDataFrame([("s", n, t, l, None) for n, t, l in [("s", "standard", "S"), ("a", "chapter", "Alpha"), ("b", "section", "Beta"), ("c", "clause", "Gamma"), ("d", "clause", " ")]], NODES)
    edges = spark.createDataFrame([("s", "e1", "CONTAINS", "s", "a"), ("s", "e2", "CONTAINS", "a", "b"), ("s", "e3", "CONTAINS", "b", "c"), ("s", "e4", "NEXT", "c", "c"), ("s", "e5", "CITES", "c", "nowhere"), ("s", "e6", "CONTAINS", "b", "d")], EDGES)
    return nodes, edges


def test_degrees_and_search(spark):
    nodes, edges = small(spark)
    assert {r["node_uid"]: r["degree"] for r in graph.degrees(nodes, edges).collect()} == {"s": 1, "a": 2, "b": 3, "c": 4, "d": 1}
    assert [r["score"] for r in graph.search_labels(nodes, edges, "alpha").collect()] == [100]
    assert graph.search_labels(nodes, edges, "  ").count() == 0
    assert [r["direction"] for r in graph.relations(nodes, edges).where("node_uid = 'c' AND other_uid = 'c'").collect()] == ["out"]
    assert {r["label"] for r in graph.label_items(nodes, edges).where("node_uid = 'd'").collect()} == {"d"}


def test_traversals(spark):
    nodes, edges = small(spark)
    start = graph.start_nodes(nodes, edges)
    assert [r["node_uid"] for r in graph.breadth_first(store(nodes, edges), start, 4).orderBy("seq").collect()] == ["s", "a", "b", "c", "d"]
    assert {r["node_uid"] for r in graph.ancestors(edges, nodes.where("node_uid = 'c'")).collect()} == {"c", "b", "a", "s"}
    assert {r["node_uid"] for r in graph.prune(store(nodes, edges), "d")[0].collect()} == {"s", "a", "b", "c"}
    assert {r["node_uid"] for r in graph.prune(store(nodes, edges.where("edge_uid <> 'e6'")), "c")[0].collect()} == {"s", "d"}
    assert {r["node_uid"]: r["weight"] for r in graph.leaf_weights(graph.tree(store(nodes, edges), start)).collect()} == {"s": 2, "a": 2, "b": 2, "c": 1, "d": 1}
    found = compare.hierarchy(nodes, edges)
    assert [(r["id"], r["chapter_id"], r["section_id"]) for r in found["clauses"].orderBy("id").collect()] == [("c", "a", "b"), ("d", "a", "b")]


def test_merge(spark):
    _, edges = small(spark)
    merges = spark.createDataFrame([("s", "d", "c")], "standard_uid string, source string, target string")
    got = {(r["source_uid"], r["target_uid"]): (r["edge_uid"], r["merged_edge_ids"]) for r in edits.merge_edges(edges, merges).collect()}
    assert got[("b", "c")] == ("e3", ["e6"]) and ("c", "c") not in got


def test_payloads(spark):
    rows = [(1, '{"data":{"items":[{"clause_uid":"a","concepts":"x","requirements":[{"text":"t"}]}]}}'), (2, "{broken"), (3, '[{"id":"b"}]'), (4, '{"clause_uid":"c"}'), (5, None), (6, "{}")]
    table = spark.createDataFrame(rows, "k int, payload string")
    assert [(r["k"], r["clause_uid"], r["texts"]) for r in payloads.extraction_items(table, "k").orderBy("k").collect()] == [(1, "a", ["t"]), (3, "b", []), (4, "c", [])]
    assert [r["k"] for r in payloads.quarantined(table).orderBy("k").collect()] == [2, 5]
    scored = payloads.scored_batches(spark.range(4), lambda it: (p.assign(y=p.id * 2) for p in it), "id long, y long")
    assert {r["y"] for r in scored.collect()} == {0, 2, 4, 6}


def test_streams(spark, tmp_path):
    item = {"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "1.1.1 应检查"}]}}
    for name in ("a", "b"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "content.json").write_text(json.dumps([[item, {"type": "list", "content": {"list_items": [{"item_content": [{"type": "text", "content": "1）x"}]}]}}]], ensure_ascii=False))
    blocks = pipelines.block_stream(spark, f"{tmp_path}/in/*")
    run = pipelines.into_table(blocks.withColumn("bbox", F.lit(None).cast("array<double>")), f"{tmp_path}/blocks", f"{tmp_path}/checkpoint", ["standard_uid", "page_idx", "block_idx", "item_idx"])
    got = pipelines.run_to_end(run, lambda: pipelines.latest_version(spark, f"{tmp_path}/blocks"))
    assert sorted((r["standard_uid"], r["source_type"], r["text"]) for r in got.collect()) == [(d, k, t) for d in ("a", "b") for k, t in (("list_item", "1）x"), ("paragraph", "1.1.1 应检查"))]
    assert artifacts.unparsed(spark.createDataFrame([("x", "{"), ("y", "[]")], "uid string, json string")).count() == 1


def test_long_chains_are_followed_to_their_end(spark):
    names = ["s", *(f"n{i:02d}" for i in range(35))]
    nodes = spark.createDataFrame([("s", n, "standard" if n == "s" else "clause", n, None) for n in names], NODES)
    edges = spark.createDataFrame([("s", f"e{i}", "CONTAINS", names[i], names[i + 1]) for i in range(35)], EDGES)
    assert graph.ancestors(edges, nodes.where("node_uid = 'n34'")).count() == 36
    left, kept = graph.prune(store(nodes, edges), "n34")
    assert [r["node_uid"] for r in left.collect()] == ["s"] and kept.count() == 0


def test_pruning_stops_at_roots_and_never_empties_a_space(spark):
    nodes, edges = small(spark)
    left, kept = graph.prune(store(nodes, edges), "s", nodes.where("node_uid = 'b'"))
    assert {r["node_uid"] for r in left.collect()} == {"b", "c", "d"} and {r["edge_uid"] for r in kept.collect()} >= {"e3"}
    chain = edges.where("edge_uid IN ('e1', 'e2')")
    left, kept = graph.prune(store(nodes.where("node_uid IN ('s', 'a', 'b')"), chain), "s", nodes.limit(0))
    assert left.count() == 3 and kept.count() == 2


def test_ids_within_a_value(spark):
    values = spark.createDataFrame([("u1", 1, "see clause part:12 here"), ("u2", 1, "Part:12:x"), ("u3", 1, "(part:7), part:12"), ("u4", 1, "nothing")], "unit_uid string, position int, value string")
    known = spark.createDataFrame([("part:12", "part:12", 2), ("part:7", "part:7", 1)], "id string, alias string, alias_order int")
    assert {r["unit_uid"]: r["id"] for r in compare.resolve_ids(values, known).collect()} == {"u1": "part:12", "u2": "part:12", "u3": "part:7"}


def test_rows_without_document_stay(spark):
    jobs = spark.createDataFrame([("j1", "d1"), ("j2", None), ("j3", "d2")], "job_id string, document_id string")
    registry = spark.createDataFrame([("s", "d1"), ("t", None)], "standard_uid string, document_id string")
    nodes, edges = small(spark)
    left = edits.delete_document("d1", jobs, registry, nodes, edges)
    assert {r["job_id"] for r in left["jobs"].collect()} == {"j2", "j3"} and left["registry"].count() == 1 and left["nodes"].count() == 0


def test_numeric_entities(spark):
    from graphloom.operators import report

    rows = spark.createDataFrame([("a &#20013;&#x6587; b",), ("&lt;plain&gt;",), (None,), ("&#65;",)], "t string")
    assert [r[0] for r in rows.select(report.unescaped(F.col("t"))).collect()] == ["a 中文 b", "<plain>", None, "A"]


def test_merges_carry_properties(spark):
    nodes = spark.createDataFrame(
        [("s", "a", "clause", "A", "text a", {"x": "1", "y": "1"}, ["old"]), ("s", "b", "clause", "B", "", {"y": "2", "z": "2"}, None), ("s", "c", "clause", "C", "text c", None, None)],
        "standard_uid string, node_uid string, node_type string, label string, text_content string, properties map<string,string>, merged_aliases array<string>",
    )
    merges = spark.createDataFrame([("s", "a", "b")], "standard_uid string, source string, target string")
    got = {r["node_uid"]: r for r in edits.merge_nodes(nodes, merges, "B", new_type="topic", new_properties={"z": "3", "w": "3"}).collect()}
    b = got["b"]
    assert set(got) == {"b", "c"} and b["properties"] == {"x": "1", "y": "1", "z": "3", "w": "3"} and (b["node_type"], b["text_content"]) == ("topic", "text a")
    assert b["merged_aliases"] == ["A", "old"] and b["merged_node_ids"] == ["a", "b"] and got["c"]["properties"] is None and got["c"]["text_content"] == "text c"
    edges = spark.createDataFrame(
        [("s", "e1", "ABOUT", "a", "c", {"k": "1"}), ("s", "e2", "ABOUT", "b", "c", {"k": "2", "l": "2"}), ("s", "e3", None, "a", "b", None)],
        "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string, properties map<string,string>",
    )
    [edge] = edits.merge_edges(edges, merges).collect()
    assert (edge["edge_uid"], edge["merged_edge_ids"], edge["properties"]) == ("e1", ["e2"], {"k": "1", "l": "2"})
