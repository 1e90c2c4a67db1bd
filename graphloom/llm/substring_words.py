"""Substring dedup on a de Bruijn graph of word windows.

Every window of k words is an edge from the node of its first k - 1 words to that of its last
k - 1.  Windows of one document that share an anchor (see ``anchors``) follow one another: they
are compacted into a path before anything is shuffled.  Paths that repeat as a whole are units;
where an anchor recurs with other content the graph branches there, and one source of each such
path is unfolded into its edges, those that repeat being units of their own.  Units are then
compacted further by Spark joins: a unit's last node is the first node of the unit that follows it
in the text, so a join on that node's source coordinate gives the successors, and where a unit has
one successor only, which has no other predecessor, both are one nonbranching path (found by
pointer doubling).  The long repeated spans that remain are verified at their source coordinates:
the words of all places of a path must have one cryptographic digest.  Where they have not, two
different texts met under one 64-bit hash, and all is done anew with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.anchors import anchor_length, anchored_runs
from graphloom.llm.common import emptied, only, repeated_ids, trimmed, written
from graphloom.llm.words import BASE, SPACES, Words, mix, ngram_hashes, words_of

#: Words of an anchor at least, and hash seeds tried.
ANCHOR, SEEDS = 8, 6
CLAIMS = "array<struct<path:long,n:int,digest:binary>>"


def digests(w: Words, begin: np.ndarray, end: np.ndarray, seed: int, bits: int) -> np.ndarray:
    """Hashes of words begin:end, chained word by word; only their last ``bits`` bits."""
    h = mix(np.full(len(begin), np.uint64(seed)) + (end - begin).astype(np.uint64))
    alive, at = np.arange(len(begin)), 0
    while len(alive):
        h[alive] = mix(h[alive] * np.uint64(BASE) ^ w.hashes[begin[alive] + at])
        at += 1
        alive = alive[end[alive] - begin[alive] > at]
    return (h & np.uint64((1 << bits) - 1)).view(np.int64)


def paths(docs: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """h, p, doc_id, at: anchor, digest of the path, document, and first edge << 7 | edges."""
    size = anchor_length(window, ANCHOR)

    @trimmed
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for w in words_of(b.column("text"), SPACES):
                h = ngram_hashes(w.hashes, size)
                first, last, anchor = anchored_runs(h, w.bounds, window, size)
                p = digests(w, first, last + window, seed, bits)
                row = np.searchsorted(w.bounds, first, "right") - 1
                at = (first - w.bounds[row]) << 7 | (last - first + 1)
                yield pa.RecordBatch.from_arrays([pa.array(h[anchor].view(np.int64)), pa.array(p), pa.array(ids[w.row + row]), pa.array(at)], names=["h", "p", "doc_id", "at"])

    return docs.mapInArrow(find, "h long, p long, doc_id long, at long")


def edges(docs: DataFrame, branching: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """e, doc_id, first: the edges of the given paths (doc_id, at), with digests of their words."""
    wanted = branching.groupBy("doc_id").agg(F.collect_set("at").alias("own"))

    @trimmed
    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, own = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("own").to_pylist()
            for w in words_of(b.column("text"), SPACES):
                begin, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k in range(len(w)):
                    at = np.array(own[w.row + k], np.int64)
                    n = at & 127
                    places = np.repeat((at >> 7) - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    begin.append(places + w.bounds[k])
                    row.append(np.full(len(places), k))
                start, rows = np.concatenate(begin), np.concatenate(row)
                e = digests(w, start, start + window, seed, bits)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(ids[w.row + rows]), pa.array(start - w.bounds[rows])], names=["e", "doc_id", "first"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "own").mapInArrow(unfold, "e long, doc_id long, first long")


def repeated_units(docs: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """unit, kind, doc_id, first, n: all places of the paths (kind 0) and single edges (kind 1) that repeat."""
    found = paths(docs, window, seed, bits)
    # counts are tables of their own: adaptive execution can then split a crowded anchor in the joins with them
    anchors = written(found.groupBy("h").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("n > 1").select("h", F.expr("lo < hi").alias("branches")), "anchors")
    met = written(found.join(anchors, "h"), "met-paths")
    again = written(met.groupBy("h", "p").agg(F.count("*").alias("places")).where("places > 1").select("h", "p"), "repeated-paths")
    whole = met.join(again, ["h", "p"]).select(F.xxhash64("h", "p").alias("unit"), F.lit(0).alias("kind"), "doc_id", (F.col("at") / 128).cast("long").alias("first"), F.col("at").bitwiseAND(127).cast("int").alias("n"))
    # one source of every path whose anchor branches
    branching = met.where("branches").groupBy("h", "p").agg(F.min(F.struct("doc_id", "at")).alias("source")).select("source.*")
    own = written(edges(docs, branching, window, seed, bits), "edges")
    twice = written(own.groupBy("e").agg(F.count("*").alias("places")).where("places > 1").select("e"), "repeated-edges")
    single = own.join(twice, "e").select(F.xxhash64("e").alias("unit"), F.lit(1).alias("kind"), "doc_id", "first", F.lit(1).alias("n"))
    units = written(whole.unionByName(single), "units")
    emptied(anchors, met, again, own, twice)
    return units


def nonbranching(units: DataFrame) -> DataFrame:
    """(unit, path): the first unit of the nonbranching path that each unit lies on, for those that don't begin one."""
    places = units.groupBy("unit").agg(F.count("*").alias("places"))
    # the node between two units, by its source coordinate
    leaves = units.select("kind", "doc_id", (F.col("first") + F.col("n")).alias("node"), F.col("unit").alias("a"))
    enters = units.select("kind", "doc_id", F.col("first").alias("node"), F.col("unit").alias("b"))
    pairs = leaves.join(enters, ["kind", "doc_id", "node"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = pairs.join(places.select(F.col("unit").alias("a"), F.col("places").alias("n_a")), "a").join(places.select(F.col("unit").alias("b"), F.col("places").alias("n_b")), "b")
    # every place of a goes on with b, and every place of b comes from a: no branch, and no cycle, as texts end
    links = written(pairs.where("a <> b AND both = n_a AND both = n_b").select(F.col("b").alias("unit"), F.col("a").alias("path")), "nonbranching")
    while True:
        onward = links.select(F.col("unit").alias("path"), F.col("path").alias("before"))
        nearer = written(links.join(onward, "path", "left").select("unit", F.coalesce("before", "path").alias("path"), F.col("before").isNotNull().alias("moved")), "nonbranching")
        emptied(links)
        links = nearer
        if not links.where("moved").take(1):
            return links.select("unit", "path")


def judged(docs: DataFrame, gone: DataFrame, window: int, with_text: bool) -> DataFrame:
    """The result's columns, and ``claims``: the path, its length in windows and the words' digest of every span."""
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>, claims " + CLAIMS + ", kept string" * with_text
    span, claim = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.struct([("path", pa.int64()), ("n", pa.int32()), ("digest", pa.binary())]))

    @trimmed
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, own = b.column("doc_id").to_pylist(), b.column("gone")
            for w in words_of(b.column("text"), SPACES):
                raw, out = w.data.tobytes(), []
                for k in range(len(w)):
                    lo, hi = int(w.bounds[k]), int(w.bounds[k + 1])
                    covered, spans, claims = np.zeros(hi - lo, bool), [], []
                    bounds = zip(w.starts[lo:hi].tolist(), w.ends[lo:hi].tolist(), strict=True)
                    words = [raw[s:e] for s, e in bounds]
                    got = own[w.row + k].values
                    if got is not None and len(got):
                        kind, first, n, path, head = (got.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "first", "n", "path", "head"))
                        order = np.lexsort((path, first, kind))
                        kind, first, n, path, head = kind[order], first[order], n[order], path[order], head[order]
                        delta = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(delta, first, 1)
                        np.add.at(delta, first + n - 1 + window, -1)
                        covered = np.cumsum(delta)[:-1] > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                        spans = [{"first": int(f), "last": int(e) - 1} for f, e in zip(turn[::2], turn[1::2], strict=True)]
                        begins = np.flatnonzero(np.concatenate([[True], (head[1:] == 1) | (path[1:] != path[:-1]) | (kind[1:] != kind[:-1]) | (first[1:] != first[:-1] + n[:-1])]))
                        ends = np.append(begins[1:], len(path)) - 1
                        for f, e, p in zip(first[begins].tolist(), (first[ends] + n[ends]).tolist(), path[begins].tolist(), strict=True):
                            claims.append({"path": p, "n": e - f, "digest": hashlib.blake2b(b" ".join(words[f : e - 1 + window]), digest_size=16).digest()})
                    kept = b" ".join([words[i] for i in np.flatnonzero(~covered).tolist()])
                    out.append((ids[w.row + k], hi - lo, int(covered.sum()), hashlib.sha256(kept).hexdigest(), spans, claims, kept.decode("utf-8", "replace"))[: 6 + with_text])
                kinds = [pa.int64()] * 3 + [pa.string(), span, claim, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "claims", "kept"][: 6 + with_text])

    return docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(remove, columns)


def repeated_passages(docs: DataFrame, window: int = 35, with_text: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (and the kept words as ``kept``).

    A word goes if a window of ``window`` words around it also starts anywhere else, in the same
    document too.  Null and blank texts have no words; rows without doc_id are left out.  Every
    row is a document of its own, whatever its doc_id: a row that stands twice is two documents with
    the same text, each a second place of the other's windows.  An empty table gives no rows; columns
    other than doc_id and text are ignored, whatever their names.  ``bits`` of a hash are used at
    first (fewer in tests, to see different texts meet); results don't depend on it.
    """
    docs = only(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    if repeated_ids(docs):  # rows get keys of their own, fixed in a table
        rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        found = passages(rows.select(F.col("row").alias("doc_id"), "text"), window, with_text, bits).withColumnRenamed("doc_id", "row")
        return rows.select("row", "doc_id").join(found, "row").drop("row")
    return passages(docs, window, with_text, bits)


def passages(docs: DataFrame, window: int, with_text: bool, bits: int) -> DataFrame:
    """``repeated_passages`` of rows whose doc_id is a key."""
    for seed in range(SEEDS):
        units = repeated_units(docs, window, seed, 64 if seed else bits)
        path = nonbranching(units)
        gone = units.join(path, "unit", "left").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "first", "n", F.coalesce("path", "unit").alias("path"), F.col("path").isNull().alias("head"))).alias("gone"))
        result = written(judged(docs, gone, window, with_text), "passages")
        emptied(units)
        claims = result.select(F.explode("claims").alias("c")).groupBy("c.path").agg(F.min(F.struct("c.n", "c.digest")).alias("lo"), F.max(F.struct("c.n", "c.digest")).alias("hi"), F.count("*").alias("places"))
        if not claims.where("lo <> hi OR places < 2").take(1):
            return result.drop("claims")
        emptied(result)
    raise RuntimeError(f"different passages met under equal hashes with each of {SEEDS} seeds: is doc_id a key?")
