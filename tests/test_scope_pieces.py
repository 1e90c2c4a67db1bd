"""Lists of candidates are put together in pieces, in the order of ids; rows of megabytes are written page by page."""

import json

from pyspark.sql import functions as F

from graphloom.operators import compare
from graphloom.sources.stage import PAGE_CHECK


def test_long_lists_meet_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(compare, "PIECE", 3)
    units = spark.createDataFrame([("s", f"u{i}", "t", ["p"], [], "text", [1, 2]) for i in range(3)], "standard_uid string, unit_uid string, title string, section_path array<string>, structural_path array<string>, text string, page_span array<int>")
    clauses = [("s", f"k{i:02d}", f"s{i % 2}", "c1", None if i == 4 else f'"{i}\\') for i in range(20)]
    levels = {
        "chapters": spark.createDataFrame([("s", "c1", "一")], "standard_uid string, id string, label string"),
        "sections": spark.createDataFrame([("s", f"s{i}", "c1", "甲", "section") for i in range(2)], "standard_uid string, id string, chapter_id string, label string, scope_type string"),
        "clauses": spark.createDataFrame(clauses + clauses[:5], "standard_uid string, id string, section_id string, chapter_id string, label string"),
    }
    chosen = spark.createDataFrame([("s", "u0", "c1"), ("s", "u1", "c1")], "standard_uid string, unit_uid string, chapter_id string")
    sections = spark.createDataFrame([("s", "u0", "s0"), ("s", "u1", "s0"), ("s", "u1", "s1"), ("s", "u2", "s1")], "standard_uid string, unit_uid string, section_id string")
    back = F.from_json("piece", "array<struct<id:string>>")
    made = compare.scope_parts(units, levels, chosen, sections, [F.array_join(back["id"], ",").alias("ids"), F.size(back).cast("string").alias("sizes")])
    got = {r["unit_uid"]: r for r in made.collect()}
    want = {u: [c for c in clauses if c[2] in held] for u, held in {"u0": ["s0"], "u1": ["s0", "s1"], "u2": ["s1"]}.items()}
    assert {u: r["candidates"] for u, r in got.items()} == {u: len(x) for u, x in want.items()}
    for u, r in got.items():
        lists = json.loads(r["lists"])
        assert list(lists) == ["selected_chapters", "selected_sections", "candidate_clauses"]
        assert lists["candidate_clauses"] == [dict(zip(("id", "section_id", "chapter_id", "label"), c[1:])) for c in want[u]] and r["ids"] == ",".join(c[1] for c in want[u])
        assert lists["selected_chapters"] == ([] if u == "u2" else [{"id": "c1", "label": "一"}])
    assert got["u1"]["sizes"] == "3,3,3,3,3,3,2"
    assert spark.conf.get(PAGE_CHECK) == "1"
