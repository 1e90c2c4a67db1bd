"""Keyed tables: what a batch rewrites, what readers see, what is forgotten."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources.tables import KeyedTable

SCHEMA = "space string, id int, value string, vector double"


def rows_of(table, spark):
    found = table.read(spark)
    return {} if found is None else {(r["space"], r["id"]): (r["value"], r["vector"]) for r in found.collect()}


def test_upserts_one_after_the_other(spark, tmp_path):
    rng, table, want = random.Random(4), KeyedTable(f"{tmp_path}/t", ("space", "id"), 8), {}
    assert table.read(spark) is None and table.forget(spark) == []
    for version in range(6):
        batch = {(rng.choice("ab"), rng.randrange(40)): (f"v{version}", rng.choice([None, float(version)])) for _ in range(rng.choice([1, 5, 30]))}
        table.upsert(spark.createDataFrame([(*k, *v) for k, v in batch.items()], SCHEMA), version, ("vector",))
        for k, (value, vector) in batch.items():
            want[k] = (value, vector if vector is not None else want.get(k, (None, None))[1])
        assert rows_of(table, spark) == want
    table.upsert(spark.createDataFrame([("a", 1, "replayed", None)], SCHEMA), 5)
    assert rows_of(table, spark) == want
    before = table.current(spark)
    gone = table.forget(spark, keep=1)
    assert set(gone) == set(range(6)) - set(before.values()) and rows_of(table, spark) == want


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/t", ("space", "id"), 16)
    table.upsert(spark.range(500).select(F.lit("a").alias("space"), F.col("id").cast("int").alias("id"), F.lit("x").alias("value"), F.lit(1.0).alias("vector")), 0)
    table.upsert(spark.createDataFrame([("a", 7, "y", 2.0)], SCHEMA), 1)
    held = table.current(spark)
    assert sorted(held.values()) == [0] * 15 + [1]
    assert len(list((tmp_path / "t" / "data" / "version=1").glob("bucket=*"))) == 1
    assert rows_of(table, spark)["a", 7] == ("y", 2.0) and len(rows_of(table, spark)) == 500


def test_a_batch_that_dies_leaves_readers_where_they_were(spark, tmp_path, monkeypatch):
    table = KeyedTable(f"{tmp_path}/t", ("space", "id"), 4)
    table.upsert(spark.createDataFrame([("a", 1, "old", 1.0)], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
        new = spark.range(1).select(F.lit("a").alias("space"), F.lit(1).alias("id"), F.lit("new").alias("value"), F.lit(2.0).alias("vector"))
        with pytest.raises(OSError):
            table.upsert(new, 1)
    assert rows_of(table, spark) == {("a", 1): ("old", 1.0)}
    table.upsert(new, 1)  # the batch again
    assert rows_of(table, spark) == {("a", 1): ("new", 2.0)}


def test_an_empty_batch(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/t", ("space", "id"))
    table.upsert(spark.createDataFrame([], SCHEMA), 0)
    assert table.read(spark) is None
    table.upsert(spark.createDataFrame([("a", 1, "x", None)], SCHEMA), 1)
    assert len(rows_of(table, spark)) == 1
