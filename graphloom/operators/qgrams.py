"""Substring search by an inverted index of q-grams.

A string that holds a needle holds all q-grams of the needle.  So the posting lists of the needle's
rarest q-grams, by counts over all strings, have every string that may hold it, and ``contains``
decides: ``GramIndex`` is such a stored index for single needles.  ``substring_pairs`` joins many
strings with many needles: by the needle's first q-gram, then by the whole piece of its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.labels import search_form
from graphloom.sources.stage import cut_lineage

#: Characters of a gram; posting lists that a search intersects at most; rows of a block.
Q, LISTS, BLOCK = 3, 3, 512
#: Stands between texts: search forms have no line breaks.
BETWEEN = "\n"


def grams(text: Column, size: int = Q) -> Column:
    """The distinct runs of ``size`` characters; none in a null or shorter text."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def places(text: Column, size: int) -> Column:
    """(at, start) structs: every run of ``size`` characters with its place from 1."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1)), F.array().cast("array<string>"))  # a whole character at a time
    return F.transform(found, lambda g, i: F.struct((i + 1).alias("at"), g.alias("start")))


def substring_pairs(texts: Column, of: DataFrame, needles: Column, among: DataFrame, size: int = Q) -> DataFrame:
    """(text, needle): every distinct text of ``of`` with every distinct needle of ``among`` that it holds.

    Nulls and empty needles match nothing.  The places of a text at which some needle's first ``size``
    characters stand (all of a shorter needle) are cut to each length that needles with that beginning
    have, and the pieces meet the needles by an equi-join: rows follow the texts' characters and the
    number of different lengths, however many needles share a gram.
    """
    texts = cut_lineage(of.select(texts.alias("text")).where("text <> ''").distinct().withColumn("text_id", F.monotonically_increasing_id()))
    needles = cut_lineage(among.select(needles.alias("needle")).where("needle <> ''").distinct())
    used = F.least(F.length("needle"), F.lit(size))
    starts = cut_lineage(needles.groupBy(F.substring("needle", F.lit(1), used).alias("start")).agg(F.collect_set(F.length("needle")).alias("lengths")))
    sizes = sorted(r["s"] for r in starts.select(F.length("start").alias("s")).distinct().collect())  # at most ``size`` numbers
    if not sizes:
        return texts.select("text", F.lit("").alias("needle")).limit(0)
    found = texts.select("text_id", F.explode(F.flatten(F.array(*[places(F.col("text"), s) for s in sizes]))).alias("p")).select("text_id", "p.*")
    found = found.join(starts, "start").groupBy("text_id").agg(F.collect_set(F.struct("at", "lengths")).alias("found"))
    cut = found.join(texts, "text_id").select("text", F.explode("found").alias("p")).select("text", "p.at", F.explode("p.lengths").alias("n"))
    pieces = cut.where(F.col("at") + F.col("n") - 1 <= F.length("text")).select("text", F.substring("text", F.col("at"), F.col("n")).alias("needle")).distinct()
    return pieces.join(needles, "needle").select("text", "needle")


@dataclass
class GramIndex:
    """postings: gram and block, sorted by gram; counts: gram, n (its blocks); members: block and key columns; all stored."""

    postings: DataFrame
    counts: DataFrame
    members: DataFrame
    keys: list[str]

    def candidates(self, needle: str) -> DataFrame | None:
        """Keys of the rows of all blocks that have the needle's rarest grams; None: the needle is too short for the index."""
        spark = self.postings.sparkSession
        own = spark.range(1).select(F.explode(grams(search_form(F.lit(needle)))).alias("gram"))
        wanted = [r["gram"] for r in own.collect()]
        if not wanted:
            return None
        known = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(wanted)).collect()}  # a row a gram of the needle
        if len(known) < len(wanted):
            return self.members.select(*self.keys).limit(0)
        rarest = sorted(known, key=lambda g: (known[g], g))[:LISTS]
        blocks = self.postings.where(F.col("gram").isin(rarest)).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("block")
        return self.members.join(blocks, "block", "left_semi").select(*self.keys)

    def narrowed(self, rows: DataFrame, needle: str) -> DataFrame:
        """The rows that may hold the needle: all of them where it is too short."""
        found = self.candidates(needle)
        return rows if found is None else rows.join(found, self.keys, "left_semi")


def write_index(rows: DataFrame, keys: list[str], path: str, *texts: Column, block: int = BLOCK) -> GramIndex:
    """An index of the search forms of ``texts``, at ``path``.

    Rows stand in blocks of ``block`` neighbors by key, and a posting is a gram with a block that has
    it: neighbors share most of their grams, so postings are far fewer than pairs of rows and grams.
    They lie in ranges of grams, so that a lookup prunes files and row groups.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat_ws(BETWEEN, *[search_form(t) for t in texts])
    ranged = rows.select(*keys, text.alias("text")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    ranged.withColumn("block", F.floor(at / block)).write.parquet(f"{path}/rows")
    numbered = spark.read.parquet(f"{path}/rows")
    lists = numbered.select("block", F.explode(grams(F.col("text"))).alias("gram")).where(~F.col("gram").contains(BETWEEN)).distinct()  # a block's rows are in one task, which folds them before the shuffle
    lists.repartitionByRange(parts, "gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).sort("gram").write.parquet(f"{path}/counts")
    return read_index(spark, keys, path)


def read_index(spark: SparkSession, keys: list[str], path: str) -> GramIndex:
    return GramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/rows").select("block", *keys), keys)
