"""Whitening of embeddings, fitted on distinct vectors with multiplicities as weights.

Components are scaled to integers, so that equal vectors are equal rows: one aggregation gives the
distinct vectors and how often each occurs.  The fit runs over them alone, each weighing one or as
often as it occurs: exact sums, then a weighted product of centred blocks a task.  The d x d
covariance is all that the driver sees.  Each distinct vector is whitened once, and rows get their
result by a join on the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import joined_back, trimmed, written

COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Integers below this bound are exact as int64 in all that is done with them; larger ones are taken as Python's integers.
SAFE = 1 << 62


def integer_vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, x (array<long>): floor(scale * c) of each component; null vectors and those with a null or non-finite component are left out."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.select("vec_id", "embedding").where(usable).select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """[row, dimension] of a list column whose lists are d long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: int64 where the bound of its values allows it, else Python's integers."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums.tolist()), default=0)
    if most < SAFE:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squared(dev: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null where a long can't hold it."""
    most = max((abs(int(dev.max())), abs(int(dev.min()))), default=0) if dev.size else 0
    if dev.dtype != object and most * most * dev.shape[1] < SAFE:
        return (dev * dev).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in dev.tolist())]


def fit(distinct: DataFrame, d: int, n: int, sums: np.ndarray, weight: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, falling; their unit vectors as columns; trace) of the weighted covariance."""

    @trimmed
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            centred = (deviations(matrix(b.column("x"), d), n, sums) / n).astype(np.float64)
            total += (centred * b.column(weight).to_numpy()[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    entries = distinct.select("x", weight).mapInArrow(products, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    covariance = np.zeros((d, d))
    for r in entries:  # d * d numbers
        covariance[r["i"], r["j"]] = r["v"] / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    return values, vectors * np.where(sign == 0, 1, sign), float(np.trace(covariance))


def whiten(rows: DataFrame, components: int = 4, scale: float = 256.0, weights: str = "one") -> DataFrame:
    """One row per usable vector and component, in the columns of ``COLUMNS``.

    rows: vec_id, embedding.  ``weights``: "one" fits on each distinct vector once, "counts" as often
    as it occurs; ``n`` is the sum of weights.  Null vectors, and those with a null or non-finite
    entry, take no part; nor do vectors of another length than the most frequent one (of several, the
    longest).  Rows without vec_id, and rows that repeat, are kept as they are; other columns are left
    out.  Components without variance can't be scaled and are left out: fewer than ``components`` rows
    a vector where the vectors span fewer dimensions, none where all are equal or there are none.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, scale).withColumn("d", F.size("x"))
    distinct = written(vectors.groupBy("x", "d").agg(F.count("*").alias("rows")).withColumn("one", F.lit(1).cast("long")), "distinct-vectors")
    sizes = distinct.groupBy("d").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = int(sizes[0]["d"]) if sizes else 0
    weight = {"one": "one", "counts": "rows"}[weights]
    of_length = distinct.where(F.col("d") == d).drop("d")
    n = int(of_length.agg(F.sum(weight).alias("n")).first()["n"] or 0) if d else 0
    if not n:
        return spark.createDataFrame([], COLUMNS)
    per_dimension = of_length.select(weight, F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(19,0)") * F.col(weight)).alias("s")).collect()
    sums = np.array([int(r["s"]) for r in sorted(per_dimension, key=lambda r: r["i"])], object)
    values, directions, trace = fit(of_length, d, n, sums, weight)
    k = int((values[:components] > max(values[0], 0) * d * np.finfo(float).eps).sum())
    if not k:
        return spark.createDataFrame([], COLUMNS)
    projection = directions[:, :k] / np.sqrt(values[:k])

    @trimmed
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dev = deviations(matrix(b.column("x"), d), n, sums)
            scores = (dev / n).astype(np.float64) @ projection
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(squared(dev), pa.int64()), pa.array(scores.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, "deviation", "scores"])

    whitened = written(of_length.mapInArrow(project, "x array<long>, rows long, one long, deviation long, scores array<double>"), "whitened-vectors")
    w = F.col(weight)
    means = whitened.agg(*[(F.sum(w * F.col("scores")[i]) / n).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    centred = [F.col("scores")[i] - F.lit(means[i]) for i in range(k)]
    products = whitened.agg(*[(F.sum(w * centred[i] * centred[j]) / n).alias(f"p{i}_{j}") for i, j in pairs]).first()
    error = max(abs(products[a] - (i == j)) for a, (i, j) in enumerate(pairs))
    found = joined_back(vectors.where(F.col("d") == d).select("vec_id", "x"), whitened.select("x", "rows", "deviation", "scores"), ["x"], "rows")
    shares = F.array(*[F.lit(float(v / trace)) for v in values[:k]])
    return found.select("vec_id", "deviation", F.posexplode("scores").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error")
    )
