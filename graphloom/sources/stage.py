"""Tables between steps: cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For tables of many texts: written and read once or twice, at two thirds of the bytes.
PACKED = {"compression": "zstd"}
PAGE_CHECK = "parquet.page.size.row.check.min"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session names none, as in tests, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut_lineage(df: DataFrame, file_rows: int = 0, **options: str) -> DataFrame:
    """``df`` written once and read again, so that loops don't plan their whole history and lost executors cost little; in files of ``file_rows`` at most, if it says so, and with the writer's ``options``."""
    path = f"{shared_dir(df.sparkSession)}/graphloom-steps/{uuid.uuid4().hex}"
    df.write.options(maxRecordsPerFile=file_rows, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide_rows(spark: SparkSession) -> None:
    """For results of rows that take megabytes: Parquet's writer looks at the size of its pages after every row, where it would hold a hundred rows first; a value that the session has stays."""
    if spark.conf.get(PAGE_CHECK, None) is None:
        spark.conf.set(PAGE_CHECK, "1")


def bucketed(df: DataFrame, keys: list[str], what: str, dealt: bool = False, **options: str) -> DataFrame:
    """``df`` as a table in buckets of ``keys``, sorted by them: joins on the keys don't move it.

    ``dealt``: a step by the keys has just dealt the rows, so they don't move for the table either.
    """
    spark = df.sparkSession
    name, n = f"graphloom_{what}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df if dealt else df.repartition(n, *keys)
    df.write.options(**options).bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/graphloom-tables/{name}").saveAsTable(name)
    return spark.table(name)
