"""Helpers that several operators share: shared folders, id handling, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    There is no default: a folder of the driver's own machine would be lost on the executors of a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local["):  # one process, one machine
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def emptied(*tables: DataFrame) -> None:
    """Empties ``written`` tables that nothing reads any more."""
    for t in tables:
        t.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(t.written_path)


def hash_bits(keys: Column, df: DataFrame, bits: int) -> np.ndarray:
    """A packed bitmap with the last bits of all of ``keys`` (longs) set: a filter of fixed size, whatever the number of keys."""
    bit = keys.bitwiseAND(bits - 1)
    rows = df.select(F.shiftright(bit, 6).cast("int").alias("at"), bit.bitwiseAND(63).cast("int").alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def has_bit(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be among the bitmap's keys."""
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which what it has freed goes back to the system, as workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can neither clash nor be carried along."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def repeated_ids(docs: DataFrame) -> bool:
    """Does a doc_id stand in more than one row?"""
    return bool(docs.groupBy("doc_id").count().where("count > 1").take(1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column as numpy views; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, at least one row a range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


#: Keys with more than this part of all rows are joined by broadcast: there are at most so many of them.
HOT_KEYS = 1000


def joined_back(rows: DataFrame, distinct: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with what ``distinct`` (one row a key, with the number of its rows) has found for their key.

    A key of many rows would meet in one task.  Those with more than a thousandth of all rows are
    fewer than a thousand, so these alone are broadcast; all others meet in a shuffle.
    """
    total = distinct.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_KEYS > total
    few = F.broadcast(distinct.where(hot).drop(count))
    near = rows.join(few, keys)
    far = rows.join(F.broadcast(distinct.where(hot).select(*keys)), keys, "left_anti").hint("shuffle_merge").join(distinct.where(~hot).drop(count), keys)
    return near.unionByName(far)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
