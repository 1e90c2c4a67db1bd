"""Whole-graph traversals move numbers: no adjacency with texts, the same neighbors and trees."""

from pathlib import Path

import pytest

from graphloom.operators import graph
from graphloom.operators.numbered import number

NODES = "standard_uid string, node_uid string, node_type string, label string, text_content string"
EDGES = "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string"
SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["top_neighbors", "prune_node"])
def test_no_texts_are_stored_with_edges(spark, name):
    from graphloom.plans import catalog

    before = {t.name for t in spark.catalog.listTables()}
    assert catalog.QUERIES[name](spark, str(SF)).count() > 0
    made = [t for t in {t.name for t in spark.catalog.listTables()} - before if "graphloom" in t]
    assert not [c for t in made for c, kind in spark.table(t).dtypes if kind == "string"]


def test_ids_follow_labels_and_ends_without_a_node_count(spark):
    nodes = spark.createDataFrame([("s", n, "clause", label, None) for n, label in [("a", "z"), ("b", "y"), ("c", None), ("d", "b")]], NODES)
    edges = spark.createDataFrame([("s", f"e{i}", "NEXT", a, b) for i, (a, b) in enumerate([("a", "b"), ("a", "c"), ("a", "d"), ("d", "nowhere"), ("b", "b"), ("a", "b"), ("c", "elsewhere"), ("t", "c")])], EDGES)
    numbered = number(nodes, edges, chunk=2)
    assert [r["node_uid"] for r in numbered.ids.orderBy("id").collect()] == ["d", "c", "b", "a"]
    assert {r["node_uid"]: r["degree"] for r in numbered.degrees().join(numbered.ids, "id").collect()} == {"a": 4, "b": 4, "c": 3, "d": 2}
    assert [r["other_uid"] for r in graph.top_neighbors(numbered, 3).where("node_uid = 'a'").orderBy("r").collect()] == ["b", "c", "d"]
    adjacency = numbered.adjacency()
    near = adjacency.around(numbered.ids.select("id").withColumnRenamed("id", "a")).collect()
    assert len(near) == 10 and adjacency.hot.count() == 3
