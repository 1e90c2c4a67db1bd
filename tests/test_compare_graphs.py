"""Comparison graphs of single units: what is held, what is known of edges, odd cases."""

from graphloom.operators import compare

NODES = "standard_uid string, node_uid string, node_type string, label string, text_content string, properties map<string,string>"
EDGES = "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string"
ITEMS = "standard_uid string, document_id string, unit_uid string, position int, node_uid string, status string, reason string, evidence string"


def test_unit_graphs(spark):
    nodes = spark.createDataFrame([("s", "s", "standard", "S", None, None), ("s", "c1", "chapter", "C1", "text", {"text_content": "own"}), ("s", "c2", "chapter", "C2", None, None), ("s", "x", "clause", "X", None, None), ("s", "y", "clause", "Y", None, None)], NODES)
    edges = spark.createDataFrame([("s", "e1", "CONTAINS", "s", "c1"), ("s", "e2", "contains", "c1", "x"), ("s", "e3", "CONTAINS", "s", "c2"), ("s", "e4", "CONTAINS", "c2", "y"), ("s", "e5", "NEXT", "x", "y"), ("s", "e6", "NEXT", "x", "x")], EDGES)
    items = spark.createDataFrame([("s", "d", "u1", 1, "x", "covered", "why", None), ("s", "d", "u1", 2, "y", "not_applicable", "no", None), ("s", "d", "u2", 1, "gone", "missing", None, "seen")], ITEMS)
    units = spark.createDataFrame([("d", "u1", "unit text", ["1", "1.1"])], "document_id string, unit_uid string, text string, section_path array<string>")
    matched = spark.createDataFrame([("s", "d", "u2", "c2")], "standard_uid string, document_id string, unit_uid string, node_uid string")
    got_nodes, got_edges = compare.unit_graphs(nodes, edges, items, units, matched)
    held = {(r["unit_uid"], r["id"]): r for r in got_nodes.collect()}
    assert set(held) == {("u1", "report-compare:d:u1"), ("u1", "s"), ("u1", "c1"), ("u1", "x"), ("u2", "report-compare:d:u2"), ("u2", "s"), ("u2", "c2")}
    assert held["u1", "c1"]["properties"] == {"text_content": "own", "node_uid": "c1", "standard_uid": "s"} and held["u1", "x"]["degree"] == 4
    assert held["u1", "report-compare:d:u1"]["properties"]["section_path"] == '["1","1.1"]' and held["u2", "report-compare:d:u2"]["properties"]["text_content"] == ""
    links = {(r["unit_uid"], r["id"], r["source"], r["target"], r["edge_type"]): r["properties"] for r in got_edges.collect()}
    assert links == {
        ("u1", "e1", "s", "c1", "CONTAINS"): {"edge_uid": "e1"}, ("u1", "e2", "c1", "x", "contains"): {"edge_uid": "e2"}, ("u2", "e3", "s", "c2", "CONTAINS"): {"edge_uid": "e3"},
        ("u1", "report-compare-edge:1", "report-compare:d:u1", "x", "COVERED"): {"reason": "why"}, ("u2", "report-compare-edge:1", "report-compare:d:u2", "gone", "MISSING"): {"report_evidence": "seen"},
    }


def test_heights_and_cycles(spark):
    names = [f"n{i:02d}" for i in range(20)]
    nodes = spark.createDataFrame([("s", n, "clause", n, None, None) for n in names], NODES)
    chain = [("s", f"e{i:02d}", "CONTAINS", names[i], names[i + 1]) for i in range(19)]
    starts = spark.createDataFrame([("s", "n19"), ("s", "n03")], "standard_uid string, node_uid string")
    got = {(r["node_uid"], r["up"]) for r in compare.above(nodes, spark.createDataFrame(chain, EDGES), starts).collect()}
    assert got == {("n19", n) for n in names[:19]} | {("n03", n) for n in names[:3]}
    ring = spark.createDataFrame([*chain[:2], ("s", "z", "CONTAINS", "n02", "n00")], EDGES)
    got = {(r["node_uid"], r["up"]) for r in compare.above(nodes, ring, spark.createDataFrame([("s", "n01")], "standard_uid string, node_uid string")).collect()}
    assert got == {("n01", "n00"), ("n01", "n01"), ("n01", "n02")}


def test_counts_of_chosen_clauses(spark):
    clauses = spark.createDataFrame([(f"c{i}", f"s{i % 3}", "h") for i in range(10)], "clause_id string, section_id string, chapter_id string")
    sections = spark.createDataFrame([("u", "s0"), ("u", "s1"), ("v", "s1"), ("v", "none"), ("v", "s1")], "unit_uid string, section_id string")
    want = {tuple(r) for r in compare.chosen_clauses(clauses, sections).groupBy("unit_uid", "section_id").count().collect()}
    assert {tuple(r) for r in compare.chosen_counts(clauses, sections).collect()} == want == {("u", "s0", 4), ("u", "s1", 3), ("v", "s1", 6)}
