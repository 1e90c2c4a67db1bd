"""Hierarchical packing into windows of several lengths, without padding.

Documents are routed by length to tiers (windows of 1024, 512, 256, ... tokens), the longest tier
first.  A window starts with a document of its tier; the gap is filled from shorter tiers, with
whole documents where they fit, else with the beginning of one that is cut there and whose rest
goes back to the tier of its length.  A window is only opened while the tokens left can fill it,
and the last few go into windows of falling powers of two, so every window is full.

As in ``packing``, lengths alone decide: the histogram of lengths (bounded by the capacity) is
planned, and Spark deals the documents of each length to the planned places by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import emptied, only, partitions, trimmed, written
from graphloom.llm.tokens import encoder

TIERS = (1024, 512, 256, 128)
#: Tokens of a step group; a rank below this many is told apart from its neighbours in the plan's index.
STEP_TOKENS, RANKS = 1 << 18, 1 << 40


class Stock:
    """Documents, or rests of them, still to be placed: by length, as runs of ranks that stand for any number of documents."""

    def __init__(self, counts: dict[int, int]):
        self.lengths = sorted(n for n, c in counts.items() if c)
        self.runs = {n: [(n, 0, counts[n], 0)] for n in self.lengths}  # (length of the document, first rank, how many, used tokens)
        self.count = {n: counts[n] for n in self.lengths}
        self.tokens = sum(n * c for n, c in counts.items())

    def take(self, length: int, most: int) -> list[tuple[int, int, int, int]]:
        out, runs, left = [], self.runs[length], most
        while left:
            of, rank, n, used = runs.pop()
            k = min(n, left)
            out.append((of, rank, k, used))
            if k < n:
                runs.append((of, rank + k, n - k, used))
            left -= k
        self.count[length] -= most
        self.tokens -= most * length
        if not self.count[length]:
            del self.lengths[bisect_left(self.lengths, length)]
        return out

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        if not self.count.get(length):
            insort(self.lengths, length)
            self.runs[length], self.count[length] = [], 0
        self.runs[length].append(run)
        self.count[length] += run[2]
        self.tokens += length * run[2]

    def filler(self, gap: int) -> int:
        """The length that fills a gap best: all of it, else with one other, else most of it, else the shortest that is too long."""
        at = bisect_left(self.lengths, gap)
        if at < len(self.lengths) and self.lengths[at] == gap:
            return gap
        for i in range(at - 1, -1, -1):
            m = self.lengths[i]
            if 2 * m < gap:
                break
            if self.count.get(gap - m, 0) > (2 * m == gap):
                return m
        return self.lengths[at - 1] if at else self.lengths[at]


def plan(counts: dict[int, int], tiers: Sequence[int] = TIERS) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Places: (length, rank_from, rank_to, used, size, seq_from, offset, window).

    Documents of ``length`` with ranks in [rank_from, rank_to) give their tokens [used, used + size)
    to the sequences from ``seq_from`` on, one each, at ``offset``.  Every sequence is full.  Work and
    places depend on the number of lengths, not of documents.
    """
    tiers = sorted(tiers, reverse=True)
    if any(t & (t - 1) for t in tiers):
        raise ValueError("windows are powers of two")
    if counts and not 0 < min(counts) <= max(counts) <= tiers[0]:
        raise ValueError(f"lengths are within 1..{tiers[0]}")
    stock, places, sequences = Stock(counts), [], 0
    while stock.tokens:
        longest = stock.lengths[-1]
        window = min(t for t in tiers if t >= longest)
        n = min(stock.count[longest], stock.tokens // window)
        if not n:  # the tokens left can't fill it
            window, n = 1 << (stock.tokens.bit_length() - 1), 1
        open_groups = [(sequences, n, 0)]
        sequences += n
        while open_groups:
            first, n, offset = open_groups.pop()
            gap = window - offset
            length = (longest if longest <= window else stock.filler(gap)) if not offset else stock.filler(gap)
            k, size = min(n, stock.count[length]), min(gap, length)
            seq = first
            for of, rank, m, used in stock.take(length, k):
                places.append((of, rank, rank + m, used, size, seq, offset, window))
                seq += m
                if size < length:
                    stock.put(length - size, (of, rank, m, used + size))
            if k < n:
                open_groups.append((first + k, n - k, offset))
            if size < gap:
                open_groups.append((first, k, offset + size))
    return places


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Every document's ids: windows full of them, and the rest with its ids, since it may be cut again."""
    columns = "doc_id long, row long, start long, length int, doc_tokens long, crc long, ids binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, count = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for row, flat, bounds in enc.encode(b.column("text")):
                raw, at, rows = flat.astype("<u4", copy=False).tobytes(), (4 * bounds).tolist(), []
                for k in range(len(at) - 1):
                    ids, n = raw[at[k] : at[k + 1]] + end, (at[k + 1] - at[k]) // 4 + 1
                    for start in range(0, n, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        size = len(part) // 4
                        rows.append((doc_ids[row + k], count, start, size, n, zlib.crc32(part), part if size < capacity else None))
                        count += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    return only(docs, "doc_id", "text").mapInArrow(work, columns)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and each row's number within its length there; rows come in the order of lengths."""
    part, last, count = TaskContext.get().partitionId(), -1, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        length = b.column("length").to_numpy()
        begins = np.flatnonzero(np.diff(length, prepend=last))
        at = np.zeros(n, np.int64)
        at[begins] = begins
        nth = np.arange(n) - np.maximum.accumulate(at) + (np.arange(n) < (begins[0] if len(begins) else n)) * count
        last, count = int(length[-1]), int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(nth)], names=[*b.schema.names, "part", "nth"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step (and ids).

    A null or empty text is the end id alone; rows that repeat, and rows without doc_id, are packed
    as often as they occur; other columns are left out; no documents give no rows.  Sequences of one
    window length are spread evenly over the steps, so that every step has as many tokens and as
    many windows of each length, but for one.  What passes the driver or is broadcast is bounded by
    the longest window and the number of shuffle partitions: the histogram, its plan, and the first
    rank of each length in each range.
    """
    spark, capacity = docs.sparkSession, max(tiers)
    pieces = written(cut(docs, tokenizer, end_id, capacity), "tier-pieces")
    ranged = pieces.repartitionByRange(partitions(spark), "length", "row").sortWithinPartitions("length", "row")
    dealt = written(ranged.mapInArrow(trimmed(numbered), f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, part int, nth long"), "tier-dealt")
    emptied(pieces)
    sizes = dealt.groupBy("length", "part").count()
    base = sizes.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("base"))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = np.array(plan(counts, tiers) or np.zeros((0, 8)), np.int64)
    keys = (places[:, 0] * (capacity + 1) + places[:, 3]) * RANKS + places[:, 1]
    order = np.argsort(keys)
    places, keys = places[order], keys[order]
    many = {int(w): (int(own[:, 5].min()), int((own[:, 5] + own[:, 2] - own[:, 1]).max() - own[:, 5].min())) for w in np.unique(places[:, 7]) for own in [places[places[:, 7] == w]]}
    steps = max(1, round(sum(n * c for n, c in counts.items()) / step_tokens))
    index = spark.sparkContext.broadcast((keys, places))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step long" + ", ids binary" * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = index.value
        for b in batches:
            doc_ids, start, length, tokens, crc, rank = (b.column(c) for c in ("doc_id", "start", "length", "doc_tokens", "crc", "rank"))
            start, length, tokens, crc, rank = (c.to_numpy() for c in (start, length, tokens, crc, rank))
            row, used = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            while len(row):  # the first pieces of all rows, then the second pieces of those that are cut, ...
                of = places[np.searchsorted(keys, (length[row].astype(np.int64) * (capacity + 1) + used) * RANKS + rank[row], "right") - 1]
                size, own, whole = of[:, 4], crc[row].copy(), of[:, 4] == length[row]
                ids = b.column("ids").take(pa.array(row)) if with_ids or not whole.all() else None
                for i in np.flatnonzero(~whole).tolist():
                    own[i] = zlib.crc32(ids[i].as_buffer().slice(4 * int(used[i]), 4 * int(size[i])))
                window, seq = of[:, 7], of[:, 5] + rank[row] - of[:, 1]
                from_, among = (np.array([many[w][k] for w in window.tolist()], np.int64) for k in (0, 1))
                out = [doc_ids.take(pa.array(row)), *map(pa.array, (start[row] + used, size, own, tokens[row], seq, of[:, 6], window.astype(np.int32), (seq - from_) * steps // np.maximum(among, 1)))]
                if with_ids:
                    out.append(pa.array([None if x is None else x[4 * u : 4 * (u + s)] for x, u, s in zip(ids.to_pylist(), used.tolist(), size.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in columns.split(", ")])
                used = used + size
                more = used < length[row]
                row, used = row[more], used[more]

    ranked = dealt.join(F.broadcast(base), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "part", "row")
    return ranked.mapInArrow(trimmed(place), columns)
