"""Jobs, documents and the registry: latest state, listings, buckets, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import normative as N

# Buckets of the document list and the states that they gather.
BUCKETS = {"completed": ["ready", "succeeded"], "processing": ["running", "queued", "processing", "uploading"], "failed": ["failed"]}
# End of fixed values.


def latest(jobs: DataFrame) -> DataFrame:
    """The newest job of every document (by updated_at, then job_id); partial maxima, one row a document shuffled."""
    last = F.max(F.struct("updated_at", "job_id", "status", "progress")).alias("j")
    return jobs.groupBy("document_id").agg(last).select("document_id", "j.*")


def newest_first(rows: DataFrame, at: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(at), *ties)


def bucket(status: Column) -> Column:
    out = F.lit("other")
    for name, states in BUCKETS.items():
        out = F.when(status.isin(*states), name).otherwise(out)
    return out


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("n"))


def matching(rows: DataFrame, status: str | None, text: str | None, *fields: str) -> DataFrame:
    """Rows of a status that hold a text in any of the fields."""
    if status:
        rows = rows.where(F.col("status") == status)
    if text and text.strip():
        rows = rows.where(F.lower(F.concat_ws(" ", *fields)).contains(text.strip().lower()))
    return rows


def page(rows: DataFrame, number: int, size: int, *order) -> DataFrame:
    """A page (from 1) in the given order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def document_listing(jobs: DataFrame, registry: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents from the registry or the job log, with their newest job and their space's counts."""
    out = registry.join(latest(jobs), "document_id", "full_outer").join(stats, "standard_uid", "left")
    status = F.coalesce("graph_status", "status", F.lit("unknown"))
    return out.select("document_id", "standard_uid", status.alias("status"), "progress", F.col("job_id").alias("latest_job_id"), F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def described(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """``asked`` (standard_id or null, name of the file) with ``found_id``, code and title, and where they come from.

    An id that is given counts: its registry entry, else what the id itself says; it is never looked for
    in the file's name then.  Without one the file's name decides.  Null if none of these knows.
    """
    own = N.strip(F.lower("standard_id"))
    known = registry.groupBy("standard_id").agg(F.first(F.struct(F.col("standard_id").alias("found_id"), "code", "title")).alias("entry")).withColumnRenamed("standard_id", "own_id")
    rows = asked.withColumn("own_id", F.when(F.col("standard_id") != "", own)).join(known, "own_id", "left")
    given, named = N.id_descriptor(F.col("own_id"), F.col("name")), N.file_descriptor(F.col("name"))
    short = lambda d: F.struct(d["standard_id"].alias("found_id"), d["code"].alias("code"), d["title"].alias("title"))
    source = F.when(F.col("entry").isNotNull(), "registry").when(F.col("own_id").isNotNull() & given.isNotNull(), "id").when(F.col("own_id").isNull() & named.isNotNull(), "name")
    rows = rows.withColumn("source", source)
    entry = F.when(F.col("source") == "registry", F.col("entry")).when(F.col("source") == "id", short(given)).when(F.col("source") == "name", short(named))
    return rows.withColumn("d", entry).select(*asked.columns, "source", "d.*")


def by_document(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """The registry's entry of each document_id in ``documents``: of several the least standard_id."""
    rest = [c for c in registry.columns if c != "document_id"]
    first = registry.join(documents.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.min_by(F.struct(*rest), "standard_id").alias("e"))
    return first.select("document_id", "e.*")
