"""Texts to embed: of every type of node, in the query too."""

from pathlib import Path

import pytest

from graphloom.operators import graph_build

SF = Path("/root/testdata/sf0.001")


def test_all_types(spark):
    nodes = spark.createDataFrame([("s", "a", "reference_standard", "GB1", None), ("s", "b", "table", "x", " own "), ("s", "c", "clause", "  ", None)], "standard_uid string, node_uid string, node_type string, text_content string, embedding_text string")
    assert {(r["node_uid"], r["text"]) for r in graph_build.embedding_inputs(nodes, None).collect()} == {("a", "GB1"), ("b", "own")}
    assert [r["node_uid"] for r in graph_build.embedding_inputs(nodes).collect()] == ["b"]


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_query_takes_every_node(spark):
    from graphloom.plans import standard_queries as S

    made = {(r["standard_uid"], r["node_type"]): r["n"] for r in S.embedding_inputs(spark, str(SF)).collect()}
    assert made == {(r["standard_uid"], r["node_type"]): r["n"] for r in S.standard_graph_nodes(spark, str(SF)).collect()}
    assert {t for _, t in made} == {"standard", "chapter", "section", "clause", "table", "requirement", "concept", "reference_standard"}


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_query_against_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from graphloom.plans import standard_queries as S

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = {tuple(r) for r in con.execute(f"SELECT standard_uid, node_type, n, chars FROM ({S.ORACLE['embedding_inputs']})").fetchall()}
    assert {tuple(r) for r in S.embedding_inputs(spark, str(SF)).select("standard_uid", "node_type", "n", "chars").collect()} == want
