"""Whitening against numpy on the distinct vectors."""

import math

import numpy as np
import pytest

from graphloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, component int"


def reference(rows, components, weights="one"):
    """{(vec_id, its place): [(deviation, |whitened| by component)]}, explained"""
    usable = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in usable}) if weights == "one" else [x for _, x in usable]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in usable:
        w = (np.array(x, float) - np.array(sums, float) / n) @ vectors[:, :components] / np.sqrt(values[:components])
        out.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.abs(w)))
    return n, out, values[:components] / values.sum()


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_against_numpy(spark, weights):
    rng = np.random.default_rng(2)
    data = [(i, (rng.normal(size=6) * [9, 5, 3, 1, 1, 0.5] + 40).tolist()) for i in range(300)]
    data += [(1000 + i, data[0][1]) for i in range(200)] + [(7, data[7][1]), (None, data[8][1])]
    bad = [(2000, None), (2001, [None] * 6), (2002, [float("nan")] + [1.0] * 5), (2003, [float("-inf")] + [1.0] * 5), (2004, []), (2005, [1.0, 2.0])]
    rows = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in data + bad], SCHEMA).repartition(5)
    got = whitening.whiten(rows, 4, weights=weights).collect()
    n, want, explained = reference(data, 4, weights)
    assert len(got) == 4 * len(data)
    seen = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        seen.setdefault(r["vec_id"], []).append((r["component"], r["deviation"], abs(r["whitened"])))
    assert set(seen) == set(want)
    for i, own in want.items():
        assert sorted(seen[i]) == sorted((c + 1, dev, pytest.approx(w[c], rel=1e-7, abs=1e-9)) for dev, w in own for c in range(4))


def test_hot_vector_is_one_of_the_fit_list(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [float(i % 5), float(i % 7)], 0, 1, 2) for i in range(3000)], SCHEMA)
    got = whitening.whiten(rows).collect()
    assert {r["n"] for r in got} == {len({(1.0, 0.0)} | {(i % 5, i % 7) for i in range(0, 3000, 3)})}
    assert len(got) == 6000 and len({r["vec_id"] for r in got}) == 3000
    assert len({r["whitened"] for r in got if r["vec_id"] % 3 and r["component"] == 1}) == 1


def test_large_entries_stay_exact(spark):
    data = [(i, [3.0e15 * (i + 1), 5.0 - i]) for i in range(4)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame([(i, v, 0, 1, 2) for i, v in data], SCHEMA)).collect()}
    assert got == {i: None for i in range(4)}  # beyond a long
    assert whitening.squared(np.array([[3_000_000_000, 1]])) == [9_000_000_000_000_000_001]


def test_nothing_to_scale(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0, 1, 2), (2, [1.0, 2.0], 0, 1, 2)], SCHEMA)
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(same.limit(0)).columns == whitening.whiten(same).columns
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0, 1, 2) for i in range(5)], SCHEMA)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
