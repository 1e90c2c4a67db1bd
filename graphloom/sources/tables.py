"""Tables that take upserts: rows by key in a fixed number of buckets, of which a batch rewrites those that it touches.

A log of small files says which version's folder holds each bucket.  A version's data is written
first and its one log file last, so a reader sees a version whole or not at all, and a batch that is
repeated after its log file was written is known to be done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.edits import upsert

LOG = "version long, bucket int"
BUCKETS = 32


@dataclass
class KeyedTable:
    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _log(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def current(self, spark: SparkSession) -> dict[int, int]:
        """The version that holds each bucket: as many numbers as there are buckets."""
        log = self._log(spark)
        return {} if log is None else {r["bucket"]: r["version"] for r in log.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, spark: SparkSession, held: dict[int, int], schema=None) -> DataFrame:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())])

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The newest version; None before the first."""
        held = self.current(spark)
        return self._rows(spark, held) if held else None

    def upsert(self, batch: DataFrame, version: int, keep_old_if_null: tuple[str, ...] = ()) -> None:
        """Puts a batch, which has a key once, into the table as this version.  Numbers rise from batch to batch; one that the log has is done."""
        spark, held = batch.sparkSession, self.current(batch.sparkSession)
        log = self._log(spark)
        if log is not None and not log.where(F.col("version") >= version).isEmpty():
            return
        batch = batch.withColumn("bucket", self._bucket()).persist()
        try:
            touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
            old = {b: held[b] for b in touched if b in held}
            rows = batch.drop("bucket")
            new = upsert(self._rows(spark, old, rows.schema), rows, self.keys, keep_old_if_null) if old else rows
            new.withColumn("bucket", self._bucket()).repartition(max(len(touched), 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        finally:
            batch.unpersist()
        # one file: it appears whole, and with it the version
        spark.createDataFrame([(version, b) for b in touched], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def forget(self, spark: SparkSession, keep: int = 2) -> list[int]:
        """Empties versions of which no bucket is held by any of the last ``keep`` versions: readers of these go on undisturbed."""
        log = self._log(spark)
        if log is None:
            return []
        rows = [(r["version"], r["bucket"]) for r in log.collect()]  # a row a version and bucket it touched
        versions = sorted({v for v, _ in rows})
        needed: set[int] = set()
        for upto in versions[-keep:]:
            held = {}
            for v, b in sorted(rows):
                if v <= upto:
                    held[b] = v
            needed |= set(held.values())
        gone = [v for v in versions if v not in needed]
        for v in gone:
            spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(f"{self.path}/data/version={v}")
        return gone
