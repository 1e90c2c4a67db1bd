"""Token ids on disk: bit-plane shuffled blocks, compressed plane by plane, behind a chunk index.

File format.  A dataset is a table of *segments* in ascending document order.  A segment's
``payload`` is a sequence of *chunks*; a chunk holds ``BLOCK`` ids (the last of a segment may hold
fewer, padded to a multiple of 8) transposed into 32 bit planes, least significant first, each
compressed with zstandard on its own; a plane of zeros takes no bytes.  ``chunk_index`` has for
every chunk its offset in the payload, its number of ids and the sizes of its planes, so any id
range can be read by decoding the chunks that it touches.  ``doc_ids`` and ``n_tokens`` say which
documents a segment holds, ``local_start`` how many ids stand before it in its part; parts follow
one another by number.  Segments are stored through Spark's own writer, so that they can live in
any store that the cluster has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import only, partitions, trimmed, written
from graphloom.llm.tokens import encoder

#: Ids a chunk, and ids from which a segment is closed.
BLOCK, SEGMENT = 16_384, 131_072
SEGMENTS = (
    "part int, segment int, local_start long, n_ids long, doc_ids array<long>, n_tokens array<int>, "
    "chunk_index array<struct<offset:int,n_ids:int,planes:array<int>>>, payload binary"
)


def shuffle_planes(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> tuple[bytes, list[int]]:
    """One chunk: the compressed bit planes of uint32 ids, one after the other, and their sizes."""
    padded = np.zeros(-(-len(ids) // 8) * 8, "<u4")
    padded[: len(ids)] = ids
    planes, sizes = [], []
    for byte in padded.view(np.uint8).reshape(-1, 4).T:  # eight planes from each byte of the ids
        bits = np.unpackbits(np.ascontiguousarray(byte)[:, None], axis=1, bitorder="little").T if byte.any() else np.zeros((8, 0), np.uint8)
        for plane in bits:
            packed = compressor.compress(np.packbits(plane, bitorder="little").tobytes()) if plane.any() else b""
            planes.append(packed)
            sizes.append(len(packed))
    return b"".join(planes), sizes


def unshuffle_planes(payload: bytes, n_ids: int, sizes: list[int], decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
    n, at = -(-n_ids // 8) * 8, 0
    out = np.zeros((n, 4), np.uint8)
    for byte in range(4):
        bits = np.zeros((8, n), np.uint8)
        for j in range(8):
            if size := sizes[8 * byte + j]:
                bits[j] = np.unpackbits(np.frombuffer(decompressor.decompress(payload[at : at + size]), np.uint8), bitorder="little")
                at += size
        if any(sizes[8 * byte : 8 * byte + 8]):
            out[:, byte] = np.packbits(bits.T, axis=1, bitorder="little")[:, 0]
    return out.view("<u4")[:n_ids, 0]


def encode_segment(ids: bytes) -> tuple[list[dict], bytes]:
    """(chunk index, payload) for the ids of a segment given as little-endian uint32 bytes."""
    every, compressor = np.frombuffer(ids, "<u4"), zstandard.ZstdCompressor(level=1)
    index, parts, at = [], [], 0
    for i in range(0, len(every), BLOCK):
        block = every[i : i + BLOCK]
        data, sizes = shuffle_planes(block, compressor)
        index.append({"offset": at, "n_ids": len(block), "planes": sizes})
        parts.append(data)
        at += len(data)
    return index, b"".join(parts)


def decode_segment(index: list[dict], payload: bytes) -> bytes:
    d = zstandard.ZstdDecompressor()
    return b"".join(unshuffle_planes(payload[c["offset"] :], c["n_ids"], c["planes"], d).tobytes() for c in index)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Segments (``SEGMENTS``) of all documents in ascending doc_id order.

    The texts are dealt by ranges of doc_id and encoded after that, so ids never cross a shuffle.
    A null text is empty: its document is the end id alone.
    """

    @trimmed
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        held: list[bytes] = []
        doc_ids: list[int] = []
        n_tokens: list[int] = []
        segment = start = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, start
            n = sum(n_tokens)
            index, payload = encode_segment(b"".join(held))
            row = {"part": part, "segment": segment, "local_start": start, "n_ids": n, "doc_ids": list(doc_ids), "n_tokens": list(n_tokens), "chunk_index": index, "payload": payload}
            segment, start = segment + 1, start + n
            held.clear(), doc_ids.clear(), n_tokens.clear()
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        size = 0
        for b in batches:
            names = b.column("doc_id").to_pylist()
            for row, flat, bounds in enc.encode(b.column("text")):
                raw, at = flat.astype("<u4", copy=False).tobytes(), (4 * bounds).tolist()
                for k in range(len(at) - 1):
                    held.append(raw[at[k] : at[k + 1]] + end)
                    doc_ids.append(names[row + k])
                    n_tokens.append(len(held[-1]) // 4)
                    size += n_tokens[-1]
                    if size >= SEGMENT:
                        yield close()
                        size = 0
        if held:
            yield close()

    rows = only(docs, "doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(encode, SEGMENTS)


ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
    ("chunk_index", pa.list_(pa.struct([("offset", pa.int32()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.int32()))]))), ("payload", pa.binary()),
])


def read_documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from stored segments."""
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row a part: a number that the session sets, not the data
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    @trimmed
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                ids, start, at, rows = decode_segment(row["chunk_index"], row["payload"]), row["base"] + row["local_start"], 0, []
                for doc_id, n in zip(row["doc_ids"], row["n_tokens"], strict=True):
                    own = ids[4 * at : 4 * (at + n)]
                    rows.append((doc_id, start + at, n, zlib.crc32(own), own)[: 4 + with_ids])
                    at += n
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=[c.split()[0] for c in columns.split(", ")])

    return segments.join(bases, "part").mapInArrow(decode, columns)


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Writes all documents' ids to the shared folder in the file format and reads them back.

    One row a row of ``docs`` (repeated rows too); no rows for an empty table.
    """
    return read_documents(written(tokenize(docs, tokenizer, end_id), "token-segments", compression="none"), with_ids)
