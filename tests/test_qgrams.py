"""The q-gram index and the substring join against direct comparison."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import compare, graph, qgrams

NODES = "standard_uid string, node_uid string, node_type string, label string, text_content string, properties map<string,string>"
EDGES = "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string"


def test_substring_pairs(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("ab1:条 😀") for _ in range(n))
    texts = [some(rng.randint(0, 25)) for _ in range(200)] + [None, "", "aaaa", "b"]
    needles = [some(rng.randint(0, 6)) for _ in range(150)] + [None, "", "a", "aa", "aaaa", "not there"]
    of, among = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(x,) for x in needles], "x string")
    got = sorted(map(tuple, qgrams.substring_pairs(F.col("t"), of, F.col("x"), among).collect()))
    assert got == sorted((t, x) for t in set(texts) - {None} for x in set(needles) - {None, ""} if x in t)
    assert qgrams.substring_pairs(F.col("t"), of, F.col("x"), among.limit(0)).count() == 0
    assert qgrams.substring_pairs(F.col("t"), of.limit(0), F.col("x"), among).count() == 0


def test_texts_meet_needles_by_equality(spark):
    of, among = spark.createDataFrame([(f"part:{i}x",) for i in range(50)], "t string"), spark.createDataFrame([(f"part:{i}",) for i in range(50)], "x string")
    found = qgrams.substring_pairs(F.col("t"), of, F.col("x"), among)
    assert "Contains(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no comparing of all that share a gram
    assert found.count() == 50 + 40


def test_ids_anywhere_in_a_value(spark):
    aliases = [("part:12", "part:12", 1), ("part:1", "part:1", 2), ("clause:3.1", "3.1 Scope", 3), ("clause:9", "Nine", 4), ("sec:5", "第5节", 5)]
    values = [("a", 1, "xpart:12y"), ("b", 1, "见part:1条"), ("c", 1, "none"), ("c", 2, "PART:1"), ("d", 1, "3.1  scope - more"), ("e", 1, "in 3.1 scope"), ("f", 1, "nine lives"), ("g", 1, None), ("g", 2, "clause:9"), ("h", 1, "第5节:总则"), ("i", 1, "第5节")]
    got = {tuple(r) for r in compare.resolve_ids(spark.createDataFrame(values, "unit_uid string, position int, value string"), spark.createDataFrame(aliases, "id string, alias string, alias_order int")).collect()}
    assert got == {("a", "part:12", 1), ("b", "part:1", 1), ("c", "part:1", 0), ("d", "clause:3.1", 1), ("h", "sec:5", 1), ("i", "sec:5", 0)}


@pytest.mark.parametrize("query", ["pump", "valve 1", "红色", '"k":"pump', "zz", "no such thing", "x"])
def test_searches_with_and_without_index(spark, tmp_path, query):
    rng = random.Random(4)
    words = ["pump", "valve", "Valve 12", "红色阀门", "zz top", None, "x"]
    rows = [(f"s{i % 3}", f"n:{i}", rng.choice(["clause", "section", None]), rng.choice(words), rng.choice(words), {"k": rng.choice(["pump", "none"])} if i % 4 else None) for i in range(120)]
    nodes = spark.createDataFrame(rows, NODES)
    edges = spark.createDataFrame([(f"s{i % 3}", f"e{i}", "T", f"n:{i}", f"n:{(i * 7 + 3) // 3 * 3 % 120}") for i in range(120)], EDGES)
    index = graph.write_search_index(nodes, f"{tmp_path}/index")
    for search in (lambda ix: graph.search_labels(nodes, edges, query, 200, ix), lambda ix: graph.search_nodes(nodes, query, [F.col("node_uid")], 200, ix), lambda ix: graph.search_subgraph(nodes, edges, query, 200, ix)):
        assert [tuple(r) for r in search(index).collect()] == [tuple(r) for r in search(None).collect()]


def test_lookups_prune_the_postings(spark, tmp_path):
    nodes = spark.createDataFrame([("s", f"n:{i}", "clause", f"label {i}", None, None) for i in range(500)], NODES)
    index = graph.write_search_index(nodes, f"{tmp_path}/index")
    plan = index.candidates("label 49")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [" in plan or "PushedFilters: [Or(" in plan


def test_postings_are_of_blocks(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n:{i:04}", f"label {i}") for i in range(600)], "node_uid string, label string")
    index = qgrams.write_index(nodes, ["node_uid"], f"{tmp_path}/index", F.col("node_uid"), F.col("label"))
    each = nodes.select(F.explode(qgrams.grams(F.concat("node_uid", F.lit("\n"), "label")))).count()
    assert index.postings.count() < each / 3
    small = qgrams.write_index(nodes, ["node_uid"], f"{tmp_path}/small", F.col("node_uid"), F.col("label"), block=7)
    found = {r[0] for r in small.candidates("label 123").collect()}
    assert "n:0123" in found and len(found) < 300 and small.candidates("absent").count() == 0
