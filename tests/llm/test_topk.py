"""Pivot-table search against all inner products."""

import math
import random

import numpy as np

from graphloom.llm import topk


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-sum(a * b for a, b in zip(v, x)), c) for c, x in rows if c != q and len(x) == len(v))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(11)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    data = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centre)]) for i in range(300)]
    data += [(300 + i, list(data[0][1])) for i in range(30)] + [(400, [0.5] * 3), (420, [1.0] * 3), (440, [0.0] * 8)]
    bad = [(500, None), (520, [1.0, None] + [0.0] * 6), (540, [math.nan] + [0.0] * 7), (560, [math.inf] + [0.0] * 7), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, "q", 1) for i, v in data + bad], "vec_id long, embedding array<float>, q string, score int")
    vectors = topk.integer_vectors(table)
    ints = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in data]
    assert {r["vec_id"]: r["v"] for r in vectors.collect()} == dict(ints)
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()))
    assert got == brute(ints, [(i, v) for i, v in ints if i % 20 == 0], 20)
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 20).count() == 0


def test_pivots_spare_evaluations():
    rng = np.random.default_rng(3)
    centres = rng.integers(-100, 100, (20, 16))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-3, 4, (4000, 16))).astype(np.int64)
    ids, q = np.arange(4000), x[:10]
    pivots = topk.choose_pivots(x)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
    evaluated = topk.search_block(ids[:10], q, ids, x, topk.distances(x, pivots), pivots, best, 20)
    assert evaluated < 0.9 * 10 * 4000
    for i in range(10):
        s = x @ q[i]
        order = [c for c in np.lexsort((ids, -s)) if c != i][:20]
        assert best[i][1].tolist() == order


def test_bound_under_a_far_pivot():
    x, q, pivots = np.array([[100]]), np.array([[90]]), np.array([[10**9]])
    best = [(np.array([8000]), np.array([5]))]
    topk.search_block(np.array([0]), q, np.array([1]), x, topk.distances(x, pivots), pivots, best, 1)
    assert [c.tolist() for c in best[0]] == [[9000], [1]]


def test_repeated_rows(spark):
    rng = random.Random(2)
    data = [(i, [rng.randint(-9, 9) for _ in range(4)]) for i in range(50)]
    rows = spark.createDataFrame([*data, data[7], data[7]], "vec_id long, v array<long>")
    queries = spark.createDataFrame([data[3], data[3], data[9]], "vec_id long, v array<long>")
    got = sorted(map(tuple, topk.top_k(rows, queries, 5).collect()))
    one = brute([*data, data[7], data[7]], [data[3]], 5)
    assert got == sorted(one + one + brute([*data, data[7], data[7]], [data[9]], 5))


def test_floors_leave_out_the_own_row():
    q, x = np.array([[2, 0], [0, 1]]), np.array([[2, 0], [1, 1], [0, 3]])
    least = np.iinfo(np.int64).min
    assert topk.first_floors(np.array([5, 8]), q, np.array([5, 6, 7]), x, 2).tolist() == [0, 1]
    assert topk.first_floors(np.array([5, 8]), q, np.array([5, 6, 7]), x, 4).tolist() == [least, least]
