"""Stored adjacency, trees with pre-order numbers and distributed ranks against plain Python."""

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from graphloom.operators import graph, ranks, trees
from graphloom.operators.adjacency import around, store

NODES = "standard_uid string, node_uid string, node_type string, label string, text_content string"
EDGES = "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string"
TYPES = ["chapter", "Section", "clause", "appendix", "requirement", "concept", None]


def rank_of(kind):
    return next((n for t, n in trees.TYPE_RANKS.items() if t in (kind or "").lower()), 6)


def priority(edge_type, outbound, kind):
    back = 0 if outbound else 2
    if edge_type == "CONTAINS":
        return rank_of(kind)
    if edge_type in ("CITES", "REFERENCES"):
        return 16 + back
    return 8 + back if "require" in (kind or "") else 12 + back + rank_of(kind)


def reference(nodes, edges, root):
    kinds, labels = {n: t for n, t, _ in nodes}, {n: label for n, _, label in nodes}
    near = defaultdict(list)
    for kind, a, b in edges:
        if a in kinds and b in kinds:
            near[a].append((priority(kind, True, kinds[b]), labels[b], b))
            near[b].append((priority(kind, False, kinds[a]), labels[a], a))
    if root not in kinds:
        return {n: (None, 0, i, None, None) for i, n in enumerate(sorted(kinds))}
    level, parent, children, queue = {root: 0}, {root: None}, defaultdict(list), deque([root])
    while queue:
        at = queue.popleft()
        for _, _, b in sorted(near[at]):
            if b not in level:
                level[b], parent[b] = level[at] + 1, at
                children[at].append(b)
                queue.append(b)
    position, size, weight, stack = {}, {}, {}, [root]
    while stack:
        at = stack.pop()
        position[at] = len(position)
        stack += reversed(children[at])
    for n in sorted(position, key=position.get, reverse=True):
        size[n] = 1 + sum(size[c] for c in children[n])
        weight[n] = sum(weight[c] for c in children[n]) or 1
    deepest = max(level.values())
    out = {n: (parent[n], level[n], position[n], size[n], weight[n]) for n in level}
    for i, n in enumerate(sorted((n for n in kinds if n not in level), key=lambda n: (labels[n], n))):
        out[n] = (None, deepest + 1 + i, len(level) + i, None, None)
    return out


def test_trees_against_a_queue(spark):
    rng = random.Random(6)
    nodes, edges, want = [], [], {}
    for s in range(5):
        own = [(f"n{i:02d}", rng.choice(TYPES), f"label {rng.randint(0, 5)}") for i in range(40)]
        links = [(rng.choice(["CONTAINS", "CITES", "ABOUT", "REFERENCES"]), f"n{rng.randrange(40):02d}", f"n{rng.choice([0, 1, rng.randrange(45)]):02d}") for _ in range(45)]
        nodes += [(f"s{s}", n, t, label, None) for n, t, label in own]
        edges += [(f"s{s}", f"e{i}", *e) for i, e in enumerate(links)]
        want |= {(f"s{s}", n): v for n, v in reference(own, links, "n00" if s < 4 else None).items()}
    for chunk in (3, 10_000):
        stored = store(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), chunk)
        rows = trees.tree(stored, stored.nodes.where("node_uid = 'n00' AND standard_uid <> 's4'")).collect()
        assert len(rows) == len(nodes)
        assert {(r["standard_uid"], r["node_uid"]): (r["parent"], r["level"], r["position"], r["size"], r["weight"]) for r in rows} == want


def test_a_chain_of_sixty(spark):
    nodes = spark.createDataFrame([("s", f"n{i:02d}", "clause", f"L{i}", None) for i in range(60)], NODES)
    edges = spark.createDataFrame([("s", f"e{i}", "NEXT", f"n{i + 1:02d}", f"n{i:02d}") for i in range(59)], EDGES)
    stored = store(nodes, edges)
    got = {r["node_uid"]: (r["level"], r["position"], r["size"], r["weight"]) for r in trees.tree(stored, stored.nodes.where("node_uid = 'n05'")).collect()}
    assert all(got[f"n{i:02d}"][0] == abs(i - 5) for i in range(60))
    assert got["n05"] == (0, 0, 60, 2) and got["n59"][2:] == (1, 1) and got["n06"][2] == 54 and sorted(v[1] for v in got.values()) == list(range(60))


def test_a_graph_without_edges_and_an_empty_one(spark):
    nodes = spark.createDataFrame([("s", n, "clause", None, None) for n in "cab"], NODES)
    edges = spark.createDataFrame([], EDGES)
    stored = store(nodes, edges)
    assert {r["node_uid"]: (r["level"], r["position"]) for r in trees.tree(stored, stored.nodes.where("node_uid = 'b'")).collect()} == {"b": (0, 0), "a": (1, 1), "c": (2, 2)}
    empty = store(nodes.limit(0), edges)
    assert trees.tree(empty, empty.nodes).count() == 0


def test_ranks_and_sums_of_large_groups(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.9 else f"g{rng.randrange(5)}", rng.randrange(50), i, rng.randrange(9)) for i in range(3000)]
    rows = spark.createDataFrame(data, "g string, k int, id int, v long")
    by = defaultdict(list)
    for r in sorted(data):
        by[r[0]].append(r)
    want = {r[2]: i + 1 for own in by.values() for i, r in enumerate(own)}
    for few in (10, 100_000):
        got = ranks.group_ranks(rows, ["g"], ["k", "id"], few=few)
        assert {r["id"]: r["rank"] for r in got.collect()} == want
    sums = {r["id"]: r["s"] for r in ranks.running_sums(got, ["g"], "rank", "v", "s", chunk=37).collect()}
    for own in by.values():
        total = 0
        for r in own:
            assert sums[r[2]] == total
            total += r[3]
    first = ranks.first_rows(rows, ["g"], ["k", "id"], 7, "id")
    assert {(r["g"], r["id"], r["position"]) for r in first.collect()} == {(g, r[2], i + 1) for g, own in by.items() for i, r in enumerate(own[:7])}


def test_the_adjacency_stays_where_it_is(spark):
    nodes = spark.createDataFrame([("s", f"n{i}", "clause", f"L{i}", None) for i in range(50)], NODES)
    edges = spark.createDataFrame([("s", f"e{i}", "NEXT", "n0", f"n{i}") for i in range(50)], EDGES)
    stored = store(nodes, edges, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = stored.nodes.select("standard_uid", "node_uid", "chunks")
        plan = around(frontier, stored.near)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    near = plan[plan.index("_near_") - 4000 if plan.index("_near_") > 4000 else 0 : plan.index("_near_")]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan, near
    assert stored.near.where("node_uid = 'n0'").select("chunk").distinct().count() > 3
    assert graph.top_neighbors(stored, 2).where("node_uid = 'n0'").count() == 2
    assert around(frontier.where("node_uid = 'n0'"), stored.near).agg(F.count_distinct("other_uid")).first()[0] == 50
