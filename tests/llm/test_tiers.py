"""Hierarchical packing against plain encoding, and its plan against its rules."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import tiers

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Hello  world", "x y " * 700, "w " * 63, "same text", "same text", "漢字かな 😀 ñ ß", "é " * 900]


def sequences(places):
    """{sequence: sorted (offset, size)}, {(length, rank): sorted (used, size)}"""
    own, docs, windows = defaultdict(list), defaultdict(list), {}
    for length, lo, hi, used, size, seq, offset, window in places:
        for r in range(lo, hi):
            own[seq + r - lo].append((offset, size))
            docs[length, r].append((used, size))
            windows[seq + r - lo] = window
    return own, docs, windows


def covers(spans, total):
    at = 0
    for start, size in sorted(spans):
        assert start == at and size > 0
        at += size
    assert at == total


def test_every_window_is_full():
    rng = random.Random(4)
    for _ in range(80):
        top = rng.choice([8, 32, 64])
        counts = {n: rng.choice([1, 2, 9]) for n in rng.sample(range(1, top + 1), rng.randint(1, top))}
        own, docs, windows = sequences(tiers.plan(counts, [top, top // 2, top // 4]))
        assert Counter(n for n, _ in docs) == counts
        for (n, _), spans in docs.items():
            covers(spans, n)
        for s, spans in own.items():
            covers(spans, windows[s])
        assert sorted(own) == list(range(len(own)))
        sizes = [windows[s] for s in range(len(own))]
        assert sizes == sorted(sizes, reverse=True) and all(w & (w - 1) == 0 for w in sizes)
        cuts = sum(len(s) - 1 for s in docs.values())
        assert cuts <= len(own)  # one cut a window at most: no more than cutting the row of all documents
    assert tiers.plan({}) == []


def test_plan_does_not_grow_with_documents():
    rng = random.Random(7)
    counts = {n: rng.randint(1, 50) for n in range(1, 1025)}
    few = tiers.plan(counts)
    many = tiers.plan({n: c * 1_000_000 for n, c in counts.items()})
    assert len(many) < 3 * len(few) < 60_000
    assert sum((hi - lo) * size for _, lo, hi, _, size, *_ in many) == sum(n * c * 1_000_000 for n, c in counts.items())


def test_pack_against_plain_encoding(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(i if i else None, t, i, "p", 1, 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, start int, part string, window int, rank int")
    rows = tiers.pack(docs, BYTE, 0, (64, 32, 16), step_tokens=256, with_ids=False).collect()
    t = Tokenizer.from_file(BYTE)
    whole = {i if i else None: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(TEXTS)}
    own, told = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        own[r["sequence_id"]].append((r["offset"], r["length"]))
        told[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    for i, ids in whole.items():
        assert sorted(told[i]) == sorted(list(range(len(ids))) * 2)
    windows = {r["sequence_id"]: (r["window"], r["step"]) for r in rows}
    for s, spans in own.items():
        covers(spans, windows[s][0])
    load = Counter()
    for w, step in windows.values():
        load[step] += w
    assert sorted(load) == list(range(len(load))) and max(load.values()) - min(load.values()) <= 64 + 32 + 16 + 16
    assert tiers.pack(docs.limit(0), BYTE).count() == 0
