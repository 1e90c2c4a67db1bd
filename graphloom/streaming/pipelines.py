"""Structured Streaming: new artifacts to blocks, job events to current states, graph parts to upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.sources import artifacts
from graphloom.sources.tables import KeyedTable


def artifact_stream(spark: SparkSession, path: str, id_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """(uid, json) of artifacts as they arrive."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.regexp_extract("_metadata.file_path", id_pattern, 1).alias("uid"), F.col("value").alias("json"))


def block_stream(spark: SparkSession, path: str) -> DataFrame:
    return artifacts.standard_blocks(artifact_stream(spark, path))


def job_events(spark: SparkSession, folder: str, schema, files: str = "events.parquet") -> DataFrame:
    """The job log as a stream of the files of that name in a folder (binding of the event table)."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "purchase", "succeeded").when(kind == "error", "failed").otherwise("running")
    return rows.select(F.col("event_id").alias("job_id"), F.concat(F.lit("doc"), F.col("user_id").cast("string")).alias("document_id"), status.alias("status"), F.col("ts").alias("updated_at"))


def current_status(events: DataFrame) -> DataFrame:
    """The newest status of every document; stateful, one row of state a document."""
    return events.groupBy("document_id").agg(F.max(F.struct("updated_at", "job_id", "status")).alias("j")).select("document_id", "j.*")


def without_replays(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each job event once, however often it is replayed within the watermark's delay."""
    return events.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", delay).dropDuplicatesWithinWatermark(["job_id"])


def into_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], mode: str = "append", keep_old_if_null: tuple[str, ...] = ()) -> StreamingQuery:
    """Upserts every micro-batch into the keyed table at ``path``: only the buckets that a batch touches are
    rewritten, readers never see half of one, and a batch that is replayed changes nothing."""
    table = KeyedTable(path, tuple(keys))

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number, keep_old_if_null)

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of the table at ``path``, if it has any."""
    return KeyedTable(path, ()).read(spark)


def run_to_end(query: StreamingQuery, result: Callable[[], DataFrame]) -> DataFrame:
    query.awaitTermination()
    return result()
