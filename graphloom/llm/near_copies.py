"""Near copies by the Jaccard similarity of their word shingles: SimHash links first, then an exact set join.

Rows of one shingle set are a class, and only classes are compared.  SimHash fingerprints of the
sets, joined by their Golay keys, propose the closest pairs.  What fingerprints miss is found by
prefix filtering: two sets of similarity t share one of the first |S| - ceil(t|S|) + 1 elements of
each in any common order (shingles that a sample of the rows shows to be common come last, which
changes only how many pairs are compared).  Classes under a shingle are first compared with the
least of them.  Where a shingle still holds several components, one member of each is compared with
one of the largest, a few times over with other members: each time, what is near a dense group joins
it.  What is apart even then is compared across all members, as far as sizes and the shingle's places
in both orders allow.  So a dense group costs a few comparisons a member, and no pair that is similar
enough is left apart.

Every pair passes two bounds before its texts are fetched: the sizes, and the differing bits of two
parity bitmaps, which are never more than the shingles that only one of the sets has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import emptied, has_bit, hash_bits, only, trimmed, written
from graphloom.llm.components import connected_components
from graphloom.llm.simhash import fingerprint_links, majority_bits
from graphloom.llm.words import BASE, SPACES, mix, ngram_hashes, words_of

#: One row in so many is read to learn which shingles are common, and so many of them are kept.
SAMPLED, MOST_COMMON = 16, 200_000
#: Pairs whose texts are compared at once; longs of a parity bitmap; bits of the filter of rows whose texts are fetched.
PAIRS, PARITY, FETCHED = 128, 16, 1 << 23
#: Times at most that components under a shingle are compared by one member each.
ROUNDS = 5


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    for w in words_of(texts, SPACES, lower=True):
        for k in range(len(w)):
            own = w.hashes[w.bounds[k] : w.bounds[k + 1]]
            yield np.unique(ngram_hashes(own, min(size, len(own)))) if len(own) else own


def least_shared(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles of three or more sampled rows."""

    @trimmed
    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in shingle_sets(b.column("text"), size):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["shingle"])

    sample = docs.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).select("text")
    counted = sample.mapInArrow(all_of, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n >= 3")
    found = counted.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    hashes = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order]


def signed(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """row, digest of the shingle set (a, c), its size, fingerprint and parity bitmap, and the shingles to be looked up."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    @trimmed
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = common.value
        for b in batches:
            longs: list[tuple] = []
            parity, first = [], []
            for s in shingle_sets(b.column("text"), size):
                longs.append((int(s.sum(dtype=np.uint64)), int(mix(s * np.uint64(BASE)).sum(dtype=np.uint64)), len(s), int(majority_bits(s))))
                odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY).astype(np.uint8) & 1
                parity.append(np.packbits(odd, bitorder="little").view(np.int64))
                if len(hashes) and len(s):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    s = s[np.argsort(np.where(hashes[at] == s, counts[at], 0), kind="stable")]
                first.append(s[: len(s) - least_shared(len(s), similarity) + 1].view(np.int64))
            columns = np.array(longs, np.uint64).reshape(-1, 4).view(np.int64)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, first)]).astype(np.int32), pa.array(np.concatenate([*first, np.zeros(0, np.int64)])))
            bitmaps = pa.ListArray.from_arrays((PARITY * np.arange(len(parity) + 1)).astype(np.int32), pa.array(np.concatenate([*parity, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(columns[:, i]) for i in range(4)), bitmaps, lists], names=["row", "a", "c", "n", "fp", "parity", "first"])

    return only(docs, "row", "text").mapInArrow(sign, "row long, a long, c long, n long, fp long, parity array<long>, first array<long>")


def fetched(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """row and text of the rows in ``pairs`` (and of few others): texts that no pair needs are not shuffled."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("row")).select(F.xxhash64("row").alias("h"))
    wanted = docs.sparkSession.sparkContext.broadcast(hash_bits(F.col("h"), keys, FETCHED))

    @trimmed
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            yield b.select(["row", "text"]).filter(pa.array(has_bit(wanted.value, h)))

    return docs.select("row", "text", F.xxhash64("row").alias("h")).mapInArrow(keep, "row long, text string")


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of class representatives whose shingle sets have at least that similarity."""
    x, y = (classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"p_{k}")) for k in ("a", "b"))
    differ = sum((F.bit_count(F.col("p_a")[i].bitwiseXOR(F.col("p_b")[i])) for i in range(1, PARITY)), F.bit_count(F.col("p_a")[0].bitwiseXOR(F.col("p_b")[0])))
    may = (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9) & (differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-9)
    left = written(pairs.join(x, "a").join(y, "b").where(may).select("a", "b"), "pairs")
    texts = fetched(docs, left)

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                b = whole.slice(at, PAIRS)
                keep = []
                for x, y in zip(shingle_sets(b.column("x"), size), shingle_sets(b.column("y"), size), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = left.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    found = written(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "similar")
    emptied(left)
    return found


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def close_sizes(similarity: float) -> Column:
    """May two sets of n and m elements be similar enough?"""
    return F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9


def parted(held: DataFrame, links: DataFrame, classes: DataFrame) -> DataFrame:
    """shingle, row, at, root, n: the members of all shingles that hold more than one component."""
    roots = connected_components(links).select(F.col("node").alias("row"), "root")
    part = written(held.select("shingle", "row", "at").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "parted")
    mixed = part.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    left = written(part.join(mixed, "shingle", "left_semi").join(classes.select(F.col("rep").alias("row"), "n"), "row"), "parted")
    emptied(part)
    return left


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, component) for every row of ``docs`` (row, text): the rows that similar pairs connect, by one of them.

    ``row`` is a key without nulls or repeats, fixed in a table.  Null, empty and blank texts have no
    words and are one component; an empty table gives no rows; other columns are ignored.
    """
    rows = written(signed(docs, size, similarity), "shingles")
    of_class = F.min(F.struct("row", "fp", "parity")).alias("o")
    classes = written(rows.groupBy("a", "c", "n").agg(of_class).select("a", "c", "n", F.col("o.row").alias("rep"), F.col("o.fp").alias("fp"), F.col("o.parity").alias("parity")), "classes")

    # fingerprints of at most three differing bits
    alike = written(classes.groupBy("fp").agg(F.min("rep").alias("center")), "fingerprints")
    same = classes.join(alike, "fp").select(F.col("center").alias("a"), F.col("rep").alias("b"))
    near = fingerprint_links(alike.select("fp")).join(alike.select(F.col("fp").alias("x"), F.col("center").alias("a")), "x").join(alike.select(F.col("fp").alias("y"), F.col("center").alias("b")), "y").select("a", "b")
    tried = written(ordered(same.unionByName(near)), "tried")
    links = similar(tried, classes, docs, size, similarity)

    # the first shingles of every class
    least = rows.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    entries = least.select(F.posexplode("first").alias("at", "shingle"), "row")
    centers = written(entries.groupBy("shingle").agg(F.count("*").alias("of"), F.min("row").alias("center")).where("of > 1").select("shingle", "center"), "centers")
    held = written(entries.join(centers, "shingle").select("shingle", "row", "at", "center"), "shared-shingles")
    stars = written(ordered(held.select(F.col("center").alias("a"), F.col("row").alias("b"))).join(tried, ["a", "b"], "left_anti"), "stars")
    links = links.unionByName(similar(stars, classes, docs, size, similarity))

    seen, part = [tried, stars], parted(held, links, classes)
    for turn in range(ROUNDS):
        member = F.struct(F.xxhash64("row", "shingle", F.lit(turn)).alias("h"), "row", "n").alias("m")
        members = part.groupBy("shingle", "root").agg(F.min(member).alias("m"), F.count("*").alias("of")).select("shingle", "root", "of", "m.row", "m.n")
        chosen = members.groupBy("shingle").agg(F.max_by(F.struct("row", "n"), F.struct("of", "root")).alias("c")).select("shingle", F.col("c.row").alias("center"), F.col("c.n").alias("m"))
        pairs = ordered(members.join(chosen, "shingle").where(close_sizes(similarity)).select(F.col("row").alias("a"), F.col("center").alias("b")))
        for before in seen:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        seen.append(written(pairs, "between-components"))
        found = similar(seen[-1], classes, docs, size, similarity)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        emptied(part)
        part = parted(held, links, classes)
    other = part.select("shingle", F.col("row").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("at").alias("place"))
    # the first shingle that two sets share leaves as many as they must have in common behind it, in both orders
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
    across = part.withColumnRenamed("row", "a").join(other, "shingle").where(close_sizes(similarity) & enough & F.expr("a < b AND root <> other")).select("a", "b").distinct()
    for before in seen:
        across = across.join(before, ["a", "b"], "left_anti")
    across = written(across, "across")
    links = links.unionByName(similar(across, classes, docs, size, similarity))
    emptied(*seen, centers, held, across, part)

    roots = connected_components(links).withColumnRenamed("node", "rep")
    labelled = classes.join(roots, "rep", "left").select("a", "c", "n", F.coalesce("root", "rep").alias("component"))
    result = written(rows.select("row", "a", "c", "n").join(labelled, ["a", "c", "n"]).select("row", "component"), "components")
    emptied(rows, classes, alike)
    return result
