"""The corpus pipeline: the stages in order, each over all that the stage before it kept.

No stage needs a doc_id, or one that names a single row; a null text counts as empty; an empty table
of documents, labels or benchmark items gives a stage nothing to reject, and no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, near_copies, packing, pii, toxicity
from graphloom.llm.common import written
from graphloom.llm.queries import PII_KEY, tokenizer_path

#: What every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The session's setting that holds the key of pseudonyms.
KEY_SETTING = "spark.graphloom.pseudonymKey"
#: Near copies have this share of all their shingles, of so many words, in common.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic; rows without doc_id are scored as all others.

    Labels that teach nothing (none, of one class only, or told apart by no term) reject nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def keyed(docs: DataFrame, what: str) -> DataFrame:
    """``docs`` with a key of its own for every row, fixed in a table: doc_id may be null or repeated."""
    return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), what)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that pairs of at least 0.8 of all their five-word shingles in common connect.

    It is the row with the least doc_id, one without doc_id only if there is no other.  Every row
    counts for itself, also those of one doc_id; texts without words are one group.
    """
    rows = keyed(docs, "rows")
    groups = near_copies.near_copies(rows, SHINGLE, SIMILARITY)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("hash"), "row")
    kept = rows.select("row", order.alias("o")).join(groups, "row").groupBy("component").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows in which no window of a benchmark item occurs; doc_id may be null or repeated."""
    rows = keyed(docs, "rows")
    found = decontaminate.contamination(rows.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias("row")), "row", "left_anti").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; n_chars follows the new text.

    The key is the session's setting ``KEY_SETTING``; without it, that of the test tables.  Null texts
    stay null, rows that repeat or have no doc_id are changed as all others.
    """
    changed = pii.replace_personal_data(docs, spark.conf.get(KEY_SETTING, PII_KEY.decode()).encode())
    return changed.withColumn("n_chars", F.when(F.col("pii_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document: its sequence and its place there; a null or empty text is one end id."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, fingerprints and tokenizers have no SQL form; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
