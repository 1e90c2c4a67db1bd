"""Token store, packing and the cached encoder against plain encoding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import packing, token_store
from graphloom.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, start int, part string"
TEXTS = [None, "", " ", "a", "Hello  world", " lead", "trail ", "tab\tb \n c", "it's they'll 're", "<|endoftext|> x <|endoftext|>", "é́ ́a\x1cb c", "x " * 5000, "same text", "same text", "漢字かな 😀 ñ ß"]


def plain(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_encoding_is_exact(path):
    rng = random.Random(5)
    parts = ["a", "The", "word", "it's", "'s", " ", "  ", "\n", "\t", " ", "\x1c", "é", "é", "́", "12", "3.4", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "ﬁ", "Ÿ", "Ⱥ", "¡", "\u00ad", "\u00a0", "Σ", "I'LL", "İ", "ß", "😀", "!?", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + TEXTS
    encoder, got = Encoder(path), []
    for part in (texts, texts[::-1]):
        for _, flat, bounds in encoder.encode(pa.array(part)):
            got += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    texts = texts + texts[::-1]
    assert got == [x[:-1] for x in plain(path, texts, 0)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_are_compared_by_their_bytes(path):
    a, b = "a", "b"
    for _ in range(10):  # two words with one value under any polynomial modulo 2**64 with an odd base
        a, b = a + b, b + a
    texts = [f"x {a} y", f"x {b} y", b, a, f"{a} {b}", f"{b[:9]} {a[:9]}", f"{a[:17]} {b[:17]}"]
    got = [flat[i:j].tolist() for _, flat, bounds in Encoder(path).encode(pa.array(texts)) for i, j in zip(bounds[:-1], bounds[1:])]
    assert got == [x[:-1] for x in plain(path, texts, 0)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_full_table_starts_anew(path):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 24))) for _ in range(rng.randint(0, 900))) for _ in range(40)]
    encoder = Encoder(path, slots=1 << 11, most_pieces=700)
    for _ in range(2):
        got = [flat[i:j].tolist() for _, flat, bounds in encoder.encode(pa.array(texts)) for i, j in zip(bounds[:-1], bounds[1:])]
        assert got == [x[:-1] for x in plain(path, texts, 0)]
    assert encoder.count <= 700


def test_plane_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, token_store.BLOCK, token_store.BLOCK + 3):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert token_store.decode_segment(*token_store.encode_segment(ids.tobytes())) == ids.tobytes()


def test_store_and_read(spark):
    docs = spark.createDataFrame([(5 * i - 20, t, i, "p") for i, t in enumerate(TEXTS)], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_store.store_and_read(docs, WORD, 2).collect()}
    at = 0
    for i, ids in enumerate(plain(WORD, TEXTS, 2)):
        assert got[5 * i - 20] == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.store_and_read(docs.limit(0), WORD, 2).count() == 0


def reference_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            min(fit)[0] -= n
        else:
            bins.append([capacity - n])
    return sorted(b[0] for b in bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 16, 50])
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        used, places = defaultdict(dict), packing.plan(counts, capacity)
        ranks = defaultdict(list)
        for length, lo, hi, seq, offset in places:
            for r in range(lo, hi):
                assert offset not in used[seq + r - lo]
                used[seq + r - lo][offset] = length
                ranks[length].append(r)
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        for own in used.values():
            at = 0
            for offset in sorted(own):
                assert offset == at
                at += own[offset]
            assert at <= capacity
        left = sorted(capacity - sum(own.values()) for own in used.values())
        assert left == reference_best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


def test_pack(spark):
    docs = spark.createDataFrame([(i, t, i, "p") for i, t in enumerate(TEXTS)], DOCS)
    rows = packing.pack(docs, BYTE, 0, 64, with_ids=True).collect()
    whole, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole[r["doc_id"]].append((r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in enumerate(plain(BYTE, TEXTS, 0)):
        cut = sorted(whole[i])
        assert sum((x for _, _, x in cut), []) == ids and [p for p, _, _ in cut] == list(range(len(cut)))
        assert all(len(x) == 64 for _, _, x in cut[1:])
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(docs.limit(0), BYTE).count() == 0
