"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences.

Best fit decreasing looks at nothing but lengths, and lengths are bounded by the sequence length:
the histogram of lengths (one number a length, however many documents) is packed with a segment
tree over remaining capacities, and Spark then deals the documents of each length to the planned
places by their rank within the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import only, partitions, trimmed, written
from graphloom.llm.tokens import encoder

PLACES = "length int, rank_from long, rank_to long, seq_from long, offset long"


class CapacityTree:
    """A segment tree over remaining capacities; finds the tightest open bin in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}  # remaining -> (first sequence, how many)

    def put(self, remaining: int, first: int, n: int) -> None:
        if n and remaining:
            self.bins.setdefault(remaining, []).append((first, n))
            self._add(remaining, n)

    def take(self, remaining: int) -> tuple[int, int]:
        first, n = self.bins[remaining].pop()
        self._add(remaining, -n)
        return first, n

    def _add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is at least ``length``."""
        i = length + self.size
        while not self.count[i]:  # climb until a right neighbour's subtree has open bins
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last node of its level
                return None
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts[length]`` documents of each length: rows of ``PLACES``.

    Exactly what best fit decreasing gives document by document, but each step places all equal
    documents that go into equal bins, so that the work depends on ``capacity`` alone.
    """
    tree, places, sequences = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = tree.take(remaining)
            each = remaining // length  # a bin takes equal documents until no more fit
            full = min(n, left // each)
            for j in range(each if full else 0):
                places.append((length, rank, rank + full, first, capacity - remaining + j * length))
                rank += full
            left -= full * each
            tree.put(remaining - each * length, first, full)
            first, n = first + full, n - full
            if n and left < each:  # the last of them fill one more bin in part
                for j in range(left):
                    places.append((length, rank, rank + 1, first, capacity - remaining + j * length))
                    rank += 1
                if left:
                    tree.put(remaining - left * length, first, 1)
                    first, n, left = first + 1, n - 1, 0
            tree.put(remaining, first, n)
    return places


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Every document's ids with the end id, cut from its end into ``capacity`` long pieces."""
    columns = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for row, flat, bounds in enc.encode(b.column("text")):
                rows, raw, at = [], flat.astype("<u4", copy=False).tobytes(), (4 * bounds).tolist()
                for k in range(len(at) - 1):
                    ids, n = raw[at[k] : at[k + 1]] + end, (at[k + 1] - at[k]) // 4 + 1
                    start, piece, size = 0, 0, n % capacity or capacity
                    while start < n:
                        part = ids[4 * start : 4 * (start + size)]
                        rows.append((doc_ids[row + k], piece, start, size, zlib.crc32(part), part)[: 5 + with_ids])
                        start, piece, size = start + size, piece + 1, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=[c.split()[0] for c in columns.split(", ")])

    return only(docs, "doc_id", "text").mapInArrow(cut, columns)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece.

    A null or empty text is the end id alone; a document longer than ``capacity`` is cut, its first
    piece being the shorter one.  Rows that repeat are packed as often as they occur.  Only the
    histogram of lengths (at most ``capacity`` rows) and the plan made from it (bounded by
    ``capacity`` too) pass the driver.  Ranks within a length come from a range partitioning, so a
    length that a third of all documents share is spread over many tasks.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")  # else finding the ranges would encode again
    dealt = cut.repartitionByRange(partitions(spark), "length", "doc_id", "piece").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "dealt-pieces")
    sizes = dealt.groupBy("length", "part").count()
    base = sizes.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = F.broadcast(spark.createDataFrame(plan(counts, capacity), PLACES).withColumnRenamed("length", "of_length"))
    nth = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("nth", nth).join(base.drop("count"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(places, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("seq_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset", *["ids"] * with_ids,
    )


