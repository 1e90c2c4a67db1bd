"""Benchmark decontamination as a prefix-filtered set join over word shingles.

An item's windows must be contained in a document whole, so every shingle of a window is
necessary, and the shortest prefix of its shingles in order of rarity - the rarest one by counts
over all documents - is enough to find all candidates.  Document shingles meet the prefix shingles
in a join, the place of the shingle in its window bounds where the window can stand, and the words
are then compared exactly.  A bitmap of fixed size, of the hashes of all item shingles, keeps most
other shingles of the documents out of the joins; the larger the benchmark, the more pass it, and
nothing else changes.  Nothing of the benchmark but that bitmap passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import emptied, has_bit, hash_bits, only, trimmed, written
from graphloom.llm.words import NOT_ALPHANUMERIC, Words, ngram_hashes, words_of

WINDOW, SHINGLE = 10, 3
#: Bits of the bitmap: two megabytes.
BITMAP = 1 << 24


def shingles(w: Words, size: int) -> np.ndarray:
    """Hashes of all shingles of a size, by their first word's place."""
    return ngram_hashes(w.hashes, size) + np.uint64(size)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (as text), a window's words, joined by blanks, and their number; an item of fewer words is one window."""

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item_id").to_pylist()
            for w in words_of(b.column("text"), NOT_ALPHANUMERIC, lower=True):
                raw, out_ids, out, size = w.data.tobytes(), [], [], []
                for k in range(len(w)):
                    own = [raw[s:e] for s, e in zip(w.starts[w.bounds[k] : w.bounds[k + 1]].tolist(), w.ends[w.bounds[k] : w.bounds[k + 1]].tolist(), strict=True)]
                    for i in range(max(1, len(own) - window + 1) if own else 0):
                        out_ids.append(ids[w.row + k])
                        out.append(b" ".join(own[i : i + window]))
                        size.append(min(window, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.string()), pa.array(out, pa.binary()), pa.array(size, pa.int32())], names=["item_id", "words", "n"])

    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL")
    return named.mapInArrow(cut, "item_id string, words binary, n int").distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """words, n, place, shingle: all shingles of every distinct window; one of fewer words is its own shingle."""

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words_of(b.column("words"), NOT_ALPHANUMERIC):
                size = np.minimum(np.diff(w.bounds), SHINGLE)
                for n in range(1, SHINGLE + 1):
                    rows = np.flatnonzero(size == n)
                    count = np.diff(w.bounds)[rows] - n + 1
                    if len(rows):
                        owner = np.repeat(rows, count)
                        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                        h = shingles(w, n)[w.bounds[owner] + place]
                        own = b.take(pa.array(w.row + owner))
                        yield pa.RecordBatch.from_arrays([own.column("words"), own.column("n"), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], names=["words", "n", "place", "shingle"])

    return windows.select("words", "n").distinct().mapInArrow(cut, "words binary, n int, place int, shingle long")


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, text and text_key, which stands for the text: rows of one text have the same windows, whatever their ids."""
    return docs.select(*names, "text", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 40)).alias("text_key"))


def candidate_shingles(docs: DataFrame, wanted, sizes: list[int]) -> DataFrame:
    """text_key, places, shingles: those of every row that the bitmap lets through."""

    @trimmed
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words_of(b.column("text"), NOT_ALPHANUMERIC, lower=True):
                at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for size in sizes:
                    h = shingles(w, size)
                    maybe = np.flatnonzero(has_bit(wanted.value, h))
                    inside = np.searchsorted(w.bounds, maybe, "right") == np.searchsorted(w.bounds, maybe + size - 1, "right")
                    at.append(maybe[inside])
                    found.append(h[maybe[inside]])
                at, found = np.concatenate(at), np.concatenate(found)
                row = np.searchsorted(w.bounds, at, "right") - 1
                order = np.argsort(row, kind="stable")
                count = np.bincount(row, minlength=len(w))
                has = np.flatnonzero(count)
                bounds = pa.array(np.concatenate([[0], np.cumsum(count[has])]).astype(np.int32))
                lists = (pa.ListArray.from_arrays(bounds, pa.array(x[order])) for x in ((at - w.bounds[row]).astype(np.int64), found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("text_key").take(pa.array(w.row + has)), *lists], names=["text_key", "places", "shingles"])

    return keyed(docs).mapInArrow(find, "text_key binary, places array<long>, shingles array<long>")


def verified(docs: DataFrame, aligned: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, hits (places of hit words), windows (those that occur) for every row of ``docs``."""
    columns = "doc_id long, text_key binary, n_words long, hits array<long>, windows array<binary>"

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, hits, windows = np.zeros(b.num_rows, np.int64), [[]] * b.num_rows, [[]] * b.num_rows
            for w in words_of(b.column("text"), NOT_ALPHANUMERIC, lower=True):
                n_words[w.row : w.row + len(w)] = np.diff(w.bounds)
                raw = w.data.tobytes()
                for k, own in enumerate(b.column("own").slice(w.row, len(w)).to_pylist()):
                    hit, found = set(), set()
                    for a in own or ():
                        lo = int(w.bounds[k]) + a["lo"]
                        hi = lo + a["n"]
                        if hi <= w.bounds[k + 1] and b" ".join([raw[s:e] for s, e in zip(w.starts[lo:hi].tolist(), w.ends[lo:hi].tolist(), strict=True)]) == a["words"]:
                            hit.update(range(a["lo"], a["lo"] + a["n"]))
                            found.add(a["words"])
                    hits[w.row + k], windows[w.row + k] = sorted(hit), sorted(found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n_words), pa.array(hits, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.binary()))], names=["doc_id", "text_key", "n_words", "hits", "windows"])

    return keyed(docs, "doc_id").join(aligned, "text_key", "left").select("doc_id", "text_key", "text", "own").mapInArrow(compare, columns)



def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and the hit places and items.

    Null and empty texts have no words and are clean, items without words never occur, items
    without id are left out; items that stand twice count once.  Every row of ``docs`` has a row of
    the result, also those that repeat or have no doc_id; an empty table gives none.  Columns other
    than doc_id, text and item_id are ignored, whatever their names.
    """
    docs, sc = only(docs, "doc_id", "text"), docs.sparkSession.sparkContext
    windows = written(item_windows(items, window), "item-windows")
    of_windows = written(window_shingles(windows), "item-shingles")
    sizes = sorted(r["size"] for r in of_windows.select(F.least("n", F.lit(SHINGLE)).alias("size")).distinct().collect())
    wanted = sc.broadcast(hash_bits(F.col("shingle"), of_windows, BITMAP))
    found = written(candidate_shingles(docs, wanted, sizes), "candidate-shingles")
    wanted.destroy()
    counts = found.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("of"))
    # a window with a shingle that no document has can't occur
    prefix = of_windows.join(counts, "shingle").groupBy("words", "n").agg(F.min(F.struct("of", "shingle", "place")).alias("p"), F.countDistinct("place").alias("known")).where(F.col("known") == F.greatest(F.col("n") - F.lit(SHINGLE - 1), F.lit(1)))
    prefix = written(prefix.select("words", "n", "p.shingle", "p.place"), "prefixes")
    texts = found.groupBy("text_key").agg(F.first(F.arrays_zip("places", "shingles")).alias("own"))
    met = texts.select("text_key", F.explode("own").alias("s")).select("text_key", F.col("s.places").alias("at"), F.col("s.shingles").alias("shingle")).join(prefix, "shingle")
    aligned = met.select("text_key", F.struct((F.col("at") - F.col("place")).alias("lo"), "n", "words").alias("a")).where("a.lo >= 0").groupBy("text_key").agg(F.collect_list("a").alias("own"))
    aligned = written(aligned, "aligned")
    checked = written(verified(docs, aligned), "verified")
    emptied(of_windows, found, prefix, aligned)
    names = checked.select("text_key", F.explode("windows").alias("words")).distinct().join(windows.select("words", "item_id"), "words").groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return checked.join(names, "text_key", "left").select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "hits", items_of.alias("items"),
    )
