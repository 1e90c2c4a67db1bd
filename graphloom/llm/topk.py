"""Exact top-k inner products with a pivot table.

Vectors are scaled to integers.  Distances of every candidate to a few pivots are computed once;
by the triangle inequality |d(q,p) - d(x,p)| bounds d(q,x) from below for every pivot p, the
largest bound counts, and since <q,x> = (|q|^2 + |x|^2 - d(q,x)^2) / 2 it bounds the score from
above.  Each query evaluates candidates in the order of that bound and stops when no bound left
can reach its k-th score, which begins as its k-th score among the sampled candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import trimmed, written

#: Vectors in a block of queries and of candidates, and pivots.
QUERY_BLOCK, CANDIDATE_BLOCK, PIVOTS = 1024, 8192, 16
#: Candidate blocks a task; vectors from which pivots are chosen, and those of them that give first k-th scores.
GROUP, SAMPLE, SEEDS = 2, 4096, 1024
#: Candidates evaluated first, in bound order; each further step is four times as large.
STEP = 256


def integer_vectors(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v (array<long>): floor(scale * x) of each component; unfit vectors are left out.

    Null vectors, and those with a null or non-finite component, take no part, nor do rows
    without vec_id.
    """
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return rows.select("vec_id", "embedding").where(usable).select("vec_id", scaled.alias("v"))


def blocks(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(block, d, ids, rows, data): about ``size`` vectors (vec_id, row, v) of one length a row, as packed int64; and how many block numbers there are."""
    n = max(1, -(-vectors.count() // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (block, d), own in pdf.groupby(["block", "d"]):
            for i in range(0, len(own), size):
                part = own.iloc[i : i + size]
                out.append((block, d, part["vec_id"].to_numpy(np.int64).tobytes(), part["row"].to_numpy(np.int64).tobytes(), b"".join(np.asarray(v, np.int64).tobytes() for v in part["v"])))
        return pd.DataFrame(out, columns=["block", "d", "ids", "rows", "data"])

    dealt = vectors.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"), "d": F.size("v")})
    return dealt.groupBy("block").applyInPandas(pack, "block int, d int, ids binary, rows binary, data binary"), n


def unpack(ids: bytes, data: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(data, np.int64).reshape(len(own), d)


def choose_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Pivots far from one another: each next is the vector farthest from those chosen."""
    f = x.astype(np.float64)
    chosen, least = [0], ((f - f[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(f)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((f - f[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    f, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((f * f).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * f @ p.T, 0))


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, best: list, k: int, floors: np.ndarray | None = None) -> int:
    """Merges a candidate block into ``best`` (per query: scores and ids, best first); returns evaluations.

    ``floors``: scores that each query's k-th one is known to reach.  The bound is taken a little high
    to make up for rounding.
    """
    evaluated = 0
    floors = np.full(len(q), np.iinfo(np.int64).min) if floors is None else floors
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # in which sums are exact
    f, own_q = x.astype(kind), q.astype(kind)
    wide = x.astype(np.float64)
    norms, q_norms, q_to = (wide * wide).sum(1), (q.astype(np.float64) ** 2).sum(1), distances(q, pivots)
    # single precision: the slack makes up for its rounding, and each pivot's own for that of distances to it, which grows with them
    table, half = np.ascontiguousarray(to_pivots.T, np.float32), (norms / 2).astype(np.float32)
    slack = np.float32(1e-5 * (1 + norms.max(initial=0) + q_norms.max(initial=0)))
    squares = norms.max(initial=0) + (pivots.astype(np.float64) ** 2).sum(1)
    farthest = to_pivots.max(0, initial=0)
    for i in range(len(q)):
        low = np.zeros(len(x), np.float32)
        error = (2.0**-22 * np.maximum(farthest, q_to[i]) + 2 * np.sqrt((x.shape[1] + 4) * 2.0**-52 * (squares + q_norms[i]))).astype(np.float32)
        for near, own, off in zip(table, q_to[i].astype(np.float32), error, strict=True):
            np.maximum(low, np.abs(near - own) - off, out=low)
        bound = half - low * low / 2 + (np.float32(q_norms[i] / 2) + slack)
        scores, found = best[i]
        limit = scores[-1] if len(scores) == k else floors[i]
        left = np.flatnonzero(bound >= limit)
        order = left[np.argsort(-bound[left])]
        at, step = 0, STEP
        while at < len(order) and bound[order[at]] >= limit:
            part = order[at : at + step]
            part = part[bound[part] >= limit]
            evaluated += len(part)
            own = (f[part] @ own_q[i]).astype(np.int64)
            keep = (ids[part] != q_ids[i]) & (own >= limit)
            if keep.any():
                s, c = np.concatenate([scores, own[keep]]), np.concatenate([found, ids[part][keep]])
                top = np.lexsort((c, -s))[:k]
                scores, found = s[top], c[top]
                limit = scores[-1] if len(scores) == k else limit
            at, step = at + step, step * 4
        best[i] = (scores, found)
    return evaluated


def sampled(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) by vector length of at most ``sample`` rows, taken in the order of their ids' hashes."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r)
    return {d: (np.array([r["vec_id"] for r in own], np.int64), np.asarray([r["v"] for r in own], np.int64).reshape(len(own), d)) for d, own in by.items()}


def first_floors(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For every query the k-th best score among some candidates but its own row; the least number if there are fewer."""
    scores = q @ x.T
    scores[q_ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, pivot_count: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best inner products, ties to the smaller vec_id.

    Both sides are (vec_id, v); other columns are ignored.  A query never meets rows of its own
    vec_id; vectors of another length are no candidates; of repeated rows each counts, as a candidate
    and as a query with k rows of its own.  No candidates or queries give no rows.  Candidates lie in
    blocks with their pivot table, a few blocks make a group, and every group meets every block of
    queries in a task of bounded size that returns k rows a query at most.  The pivots, some sampled
    vectors and the number of blocks (nothing else) pass the driver.
    """
    spark = vectors.sparkSession
    vectors, queries = (written(x.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), what) for x, what in ((vectors, "vectors"), (queries, "queries")))
    sample = sampled(vectors)
    shared = spark.sparkContext.broadcast({d: (choose_pivots(x, pivot_count), ids[:SEEDS], x[:SEEDS]) for d, (ids, x) in sample.items()})
    nothing = (np.zeros((0, 1), np.int64),) * 3

    @trimmed
    def with_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for ids, data, d in zip(b.column("ids").to_pylist(), b.column("data").to_pylist(), b.column("d").to_pylist(), strict=True):
                p = shared.value.get(d, nothing)[0]
                near.append(distances(unpack(ids, data, d)[1], p).tobytes() if len(p) else b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.binary())], names=[*b.schema.names, "near"])

    (candidates, n_c), (asked, n_q) = blocks(vectors, CANDIDATE_BLOCK), blocks(queries, QUERY_BLOCK)
    candidates = written(candidates.mapInArrow(with_table, "block int, d int, ids binary, rows binary, data binary, near binary").drop("rows"), "candidates")
    asked = written(asked, "asked")
    every_q, every_g = F.sequence(F.lit(0), F.lit(n_q - 1)), F.sequence(F.lit(0), F.lit((n_c - 1) // GROUP))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for a in right.to_pylist():
            q_ids, q = unpack(a["ids"], a["data"], a["d"])
            pivots, seed_ids, seeds = shared.value.get(a["d"], nothing)
            floors = first_floors(q_ids, q, seed_ids, seeds, k) if len(seeds) else None
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
            for c in left.to_pylist():
                if c["d"] == a["d"]:
                    ids, x = unpack(c["ids"], c["data"], c["d"])
                    near = np.frombuffer(c["near"]).reshape(len(ids), -1) if c["near"] else np.zeros((len(ids), 0))
                    search_block(q_ids, q, ids, x, near, pivots if c["near"] else np.zeros((0, c["d"]), np.int64), best, k, floors)
            size = [len(found) for _, found in best]
            for to, x in zip(out, (np.repeat(np.frombuffer(a["rows"], np.int64), size), np.repeat(q_ids, size), *(np.concatenate([b[i] for b in best]) for i in (1, 0))), strict=True):
                to.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], names=["row", "query_id", "vec_id", "score"])

    left = candidates.withColumn("g", (F.col("block") / GROUP).cast("int")).withColumn("q", F.explode(every_q)).groupBy("q", "g")
    right = asked.withColumn("g", F.explode(every_g)).withColumnRenamed("block", "q").groupBy("q", "g")
    partial = left.cogroup(right).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
