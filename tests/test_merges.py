"""Batches of merges against merging one after the other."""

import random

from pyspark.sql import functions as F

from graphloom.operators import edits, merges

NODES = "standard_uid string, node_uid string, node_type string, label string, text_content string, properties map<string,string>, merged_aliases array<string>"
MERGES = "standard_uid string, seq long, source string, target string, label string, node_type string, text_content string, properties map<string,string>"
EDGES = "standard_uid string, edge_uid string, edge_type string, source_uid string, target_uid string, properties map<string,string>"


def one_by_one(nodes, edges, batch):
    """Nodes as {uid: [label, type, text, properties, labels, uids]} and where each has gone."""
    state = {n["node_uid"]: [n["label"], n["node_type"], n["text_content"] or "", dict(n["properties"] or {}), {n["label"]}, {n["node_uid"]}] for n in nodes}
    gone, merged = {}, set()

    def now(uid):
        while uid in gone:
            uid = gone[uid]
        return uid

    for m in sorted(batch, key=lambda m: m["seq"]):
        source, target = m["source"], m["target"]
        if source not in state or source in gone or target not in state or now(target) == source:
            continue
        target = now(target)
        s, t = state[source], state[target]
        state[target] = [
            m["label"] or s[0], m["node_type"] or s[1] or "unknown", m["text_content"] or s[2] or t[2], t[3] | s[3] | (m["properties"] or {}),
            s[4] | t[4] | ({m["label"]} if m["label"] else set()), s[5] | t[5],
        ]
        gone[source] = target
        merged.add(target)
    folded = {}
    for e in sorted(edges, key=lambda e: e["edge_uid"]):
        a, b = now(e["source_uid"]), now(e["target_uid"])
        if a != b:
            own = folded.setdefault((a, b, e["edge_type"] or "RELATED_TO"), [e["edge_uid"], [], {}])
            own[1] += [e["edge_uid"]] * (own[0] != e["edge_uid"])
            own[2] = (e["properties"] or {}) | own[2]
    return {u: v for u, v in state.items() if u not in gone}, merged, folded


def test_batches_against_one_by_one(spark):
    rng = random.Random(12)
    all_nodes, all_edges, all_merges, want = [], [], [], {}
    for s in range(12):
        n = 14
        nodes = [dict(standard_uid=f"s{s}", node_uid=f"n{i}", node_type=rng.choice(["a", "b", None]), label=f"L{i}", text_content=rng.choice([None, "", f"text {i}"]), properties=rng.choice([None, {f"k{rng.randrange(4)}": f"v{i}"}]), merged_aliases=None) for i in range(n)]
        edges = [dict(standard_uid=f"s{s}", edge_uid=f"e{i:02d}", edge_type=rng.choice(["T", "U", None]), source_uid=f"n{rng.randrange(n)}", target_uid=f"n{rng.randrange(n + 2)}", properties=rng.choice([None, {f"p{rng.randrange(3)}": str(i)}])) for i in range(40)]
        batch = [dict(standard_uid=f"s{s}", seq=i, source=f"n{rng.randrange(n)}", target=f"n{rng.randrange(n + 1)}", label=rng.choice([None, None, f"M{i}"]), node_type=rng.choice([None, "m"]), text_content=rng.choice([None, f"edit {i}"]), properties=rng.choice([None, {f"k{rng.randrange(4)}": f"e{i}"}])) for i in range(rng.choice([0, 3, 9, 14]))]
        want[f"s{s}"] = one_by_one(nodes, edges, batch)
        all_nodes, all_edges, all_merges = all_nodes + nodes, all_edges + edges, all_merges + batch
    out, links = merges.merge_entities(spark.createDataFrame(all_nodes, NODES), spark.createDataFrame(all_edges, EDGES), spark.createDataFrame(all_merges, MERGES))
    by = {}
    for r in out.collect():
        by.setdefault(r["standard_uid"], {})[r["node_uid"]] = r
    for s, (state, merged, folded) in want.items():
        assert set(by[s]) == set(state)
        for uid, (label, kind, text, properties, labels, uids) in state.items():
            r = by[s][uid]
            if uid in merged:
                assert (r["label"], r["node_type"], r["text_content"]) == (label, kind, text), (s, uid)
                assert (r["properties"] or {}) == properties and r["merged_aliases"] == sorted(labels - {label}) and r["merged_node_ids"] == sorted(uids), (s, uid)
            else:
                assert r["merged_node_ids"] is None and r["label"] == label
        got = {(r["source_uid"], r["target_uid"], r["edge_type"]): [r["edge_uid"], r["merged_edge_ids"], r["properties"]] for r in links.where(F.col("standard_uid") == s).collect()}
        assert got == folded


def test_many_into_one_and_a_long_chain(spark):
    nodes = spark.createDataFrame([("s", f"n{i:03d}", "t", f"L{i}", None, {"k": str(i)}, None) for i in range(200)], NODES)
    fan = spark.createDataFrame([("s", i, f"n{i:03d}", "n000") for i in range(1, 200)], "standard_uid string, seq long, source string, target string")
    edges = spark.createDataFrame([], EDGES)
    [one] = merges.merge_entities(nodes, edges, fan)[0].collect()
    assert one["properties"] == {"k": "199"} and one["label"] == "L199" and len(one["merged_node_ids"]) == 200
    chain = spark.createDataFrame([("s", rank, f"n{i:03d}", f"n{i + 1:03d}") for rank, i in enumerate(random.Random(2).sample(range(199), 199))], "standard_uid string, seq long, source string, target string")
    [one] = merges.merge_entities(nodes, edges, chain)[0].collect()
    assert one["node_uid"] == "n199" and one["properties"] == {"k": "0"} and one["label"] == "L0"


def test_source_wins_over_target_and_edit_over_both(spark):
    nodes = spark.createDataFrame([("s", "a", None, "A", " ", {"x": "1", "y": "1"}, ["older"]), ("s", "b", "clause", "B", "text b", {"y": "2", "z": "2"}, ["other"])], NODES)
    pair = spark.createDataFrame([("s", "a", "b")], "standard_uid string, source string, target string")
    [b] = edits.merge_nodes(nodes, pair, "B", new_properties={"z": "3"}).collect()
    assert b["properties"] == {"x": "1", "y": "1", "z": "3"} and b["node_type"] == "unknown" and b["text_content"] == "text b"
    assert b["merged_aliases"] == ["A", "older"]  # the source's list, as its properties, wins


def test_fields_of_edits(spark):
    rows = [("s", "n", {"entity_name": " New ", "label": " ", "entity_type": "", "size": "3", "nothing": None, "properties": "ignored"}, {"size": "1", "w": "2"})]
    table = spark.createDataFrame(rows, "standard_uid string, node_uid string, fields map<string,string>, properties map<string,string>")
    [r] = merges.normalized_edits(table, merges.ENTITY_FIELDS).collect()
    assert (r["label"], r["node_type"], r["text_content"]) == ("New", None, None) and r["properties"] == {"size": "3", "w": "2"}
