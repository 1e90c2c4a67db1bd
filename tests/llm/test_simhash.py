"""Fingerprints, Golay keys, links and components against brute force."""

import re

import numpy as np
import xxhash

from graphloom.llm import simhash
from graphloom.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(4)
    for errors in range(4):
        x = rng.integers(0, 2**64, 500, dtype=np.uint64)
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, errors, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        own = [set() for _ in x], [set() for _ in x]
        for sets, values in zip(own, (x, y), strict=True):
            for place, key in zip(*simhash.keys(values), strict=True):
                sets[place].add(key)
        assert all(a & b for a, b in zip(*own, strict=True))


def test_components(spark):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(90)] + [(2000, 2000 + i) for i in range(1, 150)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == brute_components(nodes, pairs) if all(a != b for a, b in pairs) else {n: r for n, r in brute_components(nodes, [p for p in pairs if p[0] != p[1]]).items()} == got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = [None, "", " \n", "one", "Two words", "two  WORDS", "a\x0bb c", "É é é x", "long " * 20000]
    for _ in range(25):
        base = list(rng.choice(vocabulary, 400))
        texts.append(" ".join(base))
        for _ in range(6):
            own = list(base)
            for at in rng.integers(0, len(own), 2):
                own[at] = str(rng.choice(vocabulary))
            texts.append(rng.choice([" ", "\n", "  "]).join(own))
    docs = spark.createDataFrame([(i * 3, t, 0, None) for i, t in enumerate(texts)], "doc_id long, text string, fp int, rep string")
    fps = [brute_fingerprint(t) for t in texts]
    ids = [3 * i for i in range(len(texts))]
    linked = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = brute_components(ids, linked)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == [(i, f"{f:016x}", roots[i]) for i, f in zip(ids, fps, strict=True)]
    assert len({r for r in roots.values()}) < len(ids) - 20
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_keys_are_parted_without_loss(spark):
    rng = np.random.default_rng(5)
    fixed = rng.integers(0, 2**64, dtype=np.uint64) & np.uint64(0xFFFFFFFF00000000)
    loose = fixed | rng.integers(0, 2**32, 500, dtype=np.uint64)
    close = np.array([loose[i] ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for i in range(60)], np.uint64)
    values = np.unique(np.concatenate([loose, close])).view(np.int64)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in values], "fp long"), most=8).collect()
    u = values.view(np.uint64)
    linked = [(int(values[i]), int(values[j])) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= 3)]
    assert len(linked) >= 60 and {(min(p), max(p)) for p in map(tuple, links)} <= {(min(p), max(p)) for p in linked}
    every = [int(v) for v in values]
    assert brute_components(every, [tuple(r) for r in links]) == brute_components(every, linked)


def test_repeated_rows_and_rows_without_id(spark):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (2, "a b c d"), (9, None), (7, " ")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert rows == [(2, 2), (4, 2), (4, 2), (7, 7), (9, 7)]
