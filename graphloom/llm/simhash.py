"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four 16-bit segments.  Of at most three differing bits one
segment has none and another at most one.  Within the (23,12) Golay code every vector has a
nearest codeword within distance 3; a vector one bit away has that codeword within distance 4,
and no vector has more than six of those.  So two linked fingerprints meet under a key made of
one exact segment and one codeword of another segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import only, trimmed, written
from graphloom.llm.components import connected_components
from graphloom.llm.words import SPACES, words_of

#: Generator polynomial of the binary Golay code.
GENERATOR = 0xC75
SEGMENTS = 4
MOST_ERRORS = 3


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of every 16-bit vector, error patterns of weight <= 4 by syndrome, nearest first, -1 padded)."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    single = [syndrome(1 << b) for b in range(23)]
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, int)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            patterns[s, used[s]] = sum(1 << b for b in bits)
            used[s] += 1
    of = np.zeros(1 << 16, np.int64)
    for b in range(16):
        of[1 << b : 2 << b] = of[: 1 << b] ^ single[b]
    return of, patterns


def codewords(segment: np.ndarray) -> np.ndarray:
    """[n, 6] codeword indices (the high 12 of 23 bits) within distance 4, nearest first, -1 padded."""
    of, patterns = golay()
    errors = patterns[of[segment]]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for all keys of uint64 fingerprints."""
    seg = [((fingerprints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(SEGMENTS)]
    near = [codewords(s) for s in seg]
    places, out = [], []
    for i in range(SEGMENTS):
        for j in range(SEGMENTS):
            if i != j:
                at, slot = np.nonzero(near[j] >= 0)
                places.append(at)
                out.append(((i * SEGMENTS + j) << 28) | (seg[i][at] << 12) | near[j][at, slot])
    return np.concatenate(places), np.concatenate(out)


def majority_bits(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for c in range(0, len(h), 65536):
        ones += np.unpackbits(h[c : c + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and its fingerprint (long) from the XXH64 hashes of all word shingles."""

    @trimmed
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xxh64 = xxhash.xxh64_intdigest
        for b in batches:
            values = np.zeros(b.num_rows, np.uint64)
            for w in words_of(b.column("text"), SPACES, lower=True):
                raw = np.where(SPACES[w.data], 0x20, w.data).astype(np.uint8).tobytes()
                wide = np.flatnonzero(w.starts[1:] - w.ends[:-1] != 1) + 1  # words after another gap than one blank
                plain = np.ones(len(w), bool)
                plain[np.searchsorted(w.bounds, np.setdiff1d(wide, w.bounds), "right") - 1] = False
                for k in range(len(w)):
                    lo, hi = w.bounds[k], w.bounds[k + 1]
                    if lo == hi:
                        continue
                    starts, ends, own = w.starts[lo:hi], w.ends[lo:hi], raw
                    if not plain[k]:
                        parts = raw[starts[0] : ends[-1]].split()
                        own = b" ".join(parts)
                        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
                        starts = np.concatenate([[0], ends[:-1] + 1])
                    n = min(shingle, hi - lo)
                    h = np.array([xxh64(own[s:e], 42) for s, e in zip(starts[: len(starts) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)
                    values[w.row + k] = majority_bits(h)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(hashed, "doc_id long, fp long")


def spanning_links(values: np.ndarray, most_errors: int = MOST_ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: as many links as keep them together.

    Breadth first: each member is compared once with those not reached yet, so that a dense group
    costs little more than one pass and never yields more links than members.
    """
    a, b, rest = [], [], values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            v = queue.pop()
            near = np.bitwise_count(rest ^ v) <= most_errors
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                a.append(np.full(len(found), v))
                b.append(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (values[:0], values[:0])


#: Members of a key that one task compares; a key with more is parted by further bits.
MOST_MEMBERS = 4096
#: Bits of a key that say how far it is parted, which segments it holds, and their values.
LEVELS = 3


def parted_keys(key: np.ndarray, fps: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of the keys of the next level.

    A key of level 0 leaves two segments, 32 bits, with at most three errors: one of their four bytes
    has none.  A key of level 1 leaves three bytes: one of the four groups of six bits has none.
    """
    i, j = key >> 30 & 3, key >> 28 & 3
    rest = np.zeros(len(fps), np.uint64)
    for k in range(SEGMENTS):
        use = (i != k) & (j != k)
        rest[use] = rest[use] << np.uint64(16) | fps[use] >> np.uint64(16 * k) & np.uint64(0xFFFF)
    out = []
    if level == 0:
        for c in range(4):
            out.append(key | np.int64(1 << 60 | c << 40) | (rest >> np.uint64(8 * c) & np.uint64(255)).astype(np.int64) << 32)
    else:
        at = 8 * (key >> 40 & 3).astype(np.uint64)
        below = (np.uint64(1) << at) - np.uint64(1)
        rest = rest & below | rest >> (at + np.uint64(8)) << at  # without the byte that the key holds
        for c in range(4):
            out.append(key ^ np.int64(3 << 60) | np.int64(c << 50) | (rest >> np.uint64(6 * c) & np.uint64(63)).astype(np.int64) << 42)
    return np.tile(np.arange(len(fps)), 4), np.concatenate(out)


def compared(rows: DataFrame, level: int, most: int) -> DataFrame:
    """x, y, key: links of the members of each key; members of keys with more than ``most`` come as (x, key) of the next level."""

    @trimmed
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def parted(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            at, to = parted_keys(key, fp.view(np.uint64), level)
            return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.nulls(len(at), pa.int64()), pa.array(to)], names=["x", "y", "key"])

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(key)) + 1
            lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
            size, a, b = hi - lo, [fp[:0]], [fp[:0]]
            two = lo[size == 2]
            x, y = fp[two], fp[two + 1]
            near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= MOST_ERRORS
            a.append(x[near])
            b.append(y[near])
            for i, j in zip(lo[size > 2].tolist(), hi[size > 2].tolist(), strict=True):
                x, y = spanning_links(fp[i:j].view(np.uint64))
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            x = np.concatenate(a)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.concatenate(b)), pa.nulls(len(x), pa.int64())], names=["x", "y", "key"])

        for batch in batches:  # sorted by key: the last group of a batch may go on in the next
            key = np.concatenate([held_key, batch.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begins, len(key)))
            many = np.repeat((size > most) | (key[begins] == crowded), size) & (level + 1 < LEVELS)
            if many.any():
                yield parted(key[many], fp[many])
            crowded = key[-1] if many[-1] else None
            key, fp = key[~many], fp[~many]
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) and crowded is None else len(key)
            held_key, held_fp = key[cut:], fp[cut:]
            if cut:
                yield out(key[:cut], fp[:cut])
        if len(held_key):
            yield out(held_key, held_fp)

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(linked, "x long, y long, key long")


def fingerprint_links(distinct: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """(x, y) fingerprints that link; enough of them to connect all that are linked.

    No task holds more than ``most`` members of a key and a batch of rows, whatever the key's size:
    more of them pass as rows of parted keys, down to where a key has 30 exact bits and a codeword.
    """

    @trimmed
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            for c in range(0, len(fps), 20_000):
                part = fps[c : c + 20_000]
                at, key = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], names=["key", "fp"])

    rows, links = distinct.select("fp").mapInArrow(keyed, "key long, fp long"), None
    for level in range(LEVELS):
        found = written(compared(rows, level, most), "links")
        own = found.where("y IS NOT NULL").select("x", "y")
        links = own if links is None else links.unionByName(own)
        rows = found.where("key IS NOT NULL").select("key", F.col("x").alias("fp"))
        if not rows.take(1):
            break
    return links.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links).

    Fingerprints link at three or fewer differing bits.  Documents of one fingerprint are a class;
    only classes are linked, whatever their size.  A null, empty or blank text has fingerprint zero
    and links like any other; rows without doc_id are left out; repeated rows stay repeated; an empty
    table gives no rows; columns other than doc_id and text are ignored, whatever their names.
    """
    rows = written(fingerprints(docs), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = fingerprint_links(classes)
    x = classes.select(F.col("fp").alias("x"), F.col("rep").alias("a"))
    y = classes.select(F.col("fp").alias("y"), F.col("rep").alias("b"))
    roots = connected_components(links.join(x, "x").join(y, "y").select("a", "b"))
    labelled = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(labelled, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
