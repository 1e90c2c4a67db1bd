"""Traversals of few levels read the edges themselves and agree with those over the stored adjacency."""

import random
from pathlib import Path

import pytest

from graphloom.operators import graph
from graphloom.operators.adjacency import read, store

NODES = "standard_uid string, node_uid string, node_type string, label string, text_content string"
EDGES = "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string"
SF = Path("/root/testdata/sf0.001")


def test_read_and_stored_graphs_agree(spark):
    rng = random.Random(8)
    nodes = [(f"s{s}", f"n{i:02d}", "standard" if i == 0 else rng.choice(["chapter", "clause", None]), rng.choice(["A", "b", None]), None) for s in range(3) for i in range(30)]
    edges = [(f"s{s}", f"e{i}", rng.choice(["CONTAINS", "CITES"]), f"n{rng.choice([0, 1, rng.randrange(33)]):02d}", f"n{rng.randrange(33):02d}") for s in range(3) for i in range(45)]
    nodes, edges = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    starts = nodes.where("node_type = 'standard'")

    def found(g):
        kept, inside = graph.workbench(g, preferred=["chapter"], depth=3, most=12)
        typed = graph.typed_neighborhood(g, starts, ["chapter", "clause"], ["CONTAINS"], 2, 3, 1)
        frames = [kept, inside, graph.workbench(g, label="b")[0], graph.breadth_first(g, starts, 3, ["chapter"]), graph.incident_subgraph(g, starts, 2), typed, graph.edges_among(g, typed, ["CONTAINS"])]
        return [sorted(map(str, (sorted(r.asDict().items()) for r in f.collect()))) for f in frames]

    want = found(store(nodes, edges, 4))
    assert all(want) and found(read(nodes, edges)) == want


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["typed_neighborhood", "workbench_edges", "incident_subgraph"])
def test_few_levels_store_no_adjacency(spark, name):
    from graphloom.plans import catalog

    before = {t.name for t in spark.catalog.listTables()}
    assert catalog.QUERIES[name](spark, str(SF)).count() > 0
    assert not [t for t in {t.name for t in spark.catalog.listTables()} - before if "graphloom" in t]
