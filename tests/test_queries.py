"""Registered queries against their DuckDB forms on the smallest tables."""

import math
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
SOME = ["popular_labels", "workbench_nodes", "structure_nodes", "requirements", "standard_graph_edges", "text_units", "section_contents", "clause_status", "resolved_ids", "merge_entities", "latest_jobs", "extraction_payloads", "model_requirements", "title_rates", "sql_requirements"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from graphloom.plans import catalog

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    result = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in result.description]
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_every_query_is_named_once():
    from graphloom.plans import catalog

    assert len(catalog.QUERIES) == sum(len(m.QUERIES) for m in catalog.MODULES) and set(catalog.ORACLE) <= set(catalog.QUERIES)
