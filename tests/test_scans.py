"""Scans of long groups against reading them one after the other."""

import random

from pyspark.sql import functions as F

from graphloom.operators import report, scans


def test_states_before(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g, n in (("a", 1), ("b", 7), ("c", 8), ("d", 9), ("e", 600), (None, 70)):
        state = 0
        for i in range(n):
            step = [rng.randrange(3) for _ in range(3)]
            rows.append((g, i, step, f"{g}{i}"))
            want[f"{g}{i}"] = state
            state = step[state]
    table = spark.createDataFrame([r for r in rows if r[0]], "g string, at int, step array<int>, name string").repartition(5)
    for width in (2, 8, 64):
        got = scans.states_before(table, ["g"], "at", "step", ["name"], 3, width)
        assert {r["name"]: r["state"] for r in got.collect()} == {k: v for k, v in want.items() if not k.startswith("None")}


def test_folded(spark):
    table = spark.createDataFrame([([],), ([1],), (list(range(200)),)], "x array<int>")
    step = lambda s, x: F.struct((s + x).alias("state"), (s * 2).cast("int").alias("out"))
    got = [r[0] for r in table.select(scans.folded(F.col("x"), F.lit(0), step, "int", 16)).collect()]
    assert got == [[], [0], [2 * sum(range(i)) for i in range(200)]]


def test_a_run_of_very_many_blocks(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_idx"), (F.col("id") + 1).cast("int").alias("block_idx"), F.lit("paragraph").alias("source_type"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 500 + 1).cast("int")).alias("text"), F.lit("body").alias("page_role"))
    blocks = rows.select("document_id", "page_idx", "page_role", "source_type", F.col("block_idx").alias("pos"), F.col("text").alias("text_normalized"), F.col("block_idx").cast("string").alias("block_id"), F.expr("array(named_struct('pos', 0, 'level', 1, 'title', 't', 'structural', false))").alias("stack"))
    got = [(r["blocks"], r["pos"]) for r in report.text_units(blocks).select("blocks", "pos").orderBy("pos").collect()]
    want, chars, count = [], 0, 0
    for i in range(n):
        chars, count = chars + i * 7919 % 500 + 1, count + 1
        if chars >= 900 or count >= 4 or i == n - 1:
            want.append((count, i + 1))
            chars = count = 0
    assert got == want
