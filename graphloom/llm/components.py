"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import emptied, partitions, written


#: Links that one task takes: few links aren't spread over all partitions in every round.
TASK_LINKS = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is the component's least node.

    Each round is two aggregations with map-side combining and two equi-joins; a node with very
    many neighbours is a skewed join key, which adaptive execution splits.  Rounds grow with the
    logarithm of the largest component; each ends in a table, and only two numbers reach the driver.
    """

    def least(pairs: DataFrame, smaller_only: bool, tasks: int) -> DataFrame:
        """Links every neighbour of u that counts to the least of them."""
        both = pairs if smaller_only else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(tasks)
        told = both.join(low, "a").coalesce(tasks)
        if smaller_only:  # pairs have a > b: the neighbours b and a itself hang on m
            out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        else:  # the larger neighbours hang on m
            out = told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(tasks)

    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, mark = written(pairs, "links"), None
    tasks = min(partitions(links.sparkSession), 1 + pairs.count() // TASK_LINKS)  # links get no more from round to round
    while True:
        last, pairs = pairs, written(least(least(pairs, False, tasks), True, tasks), "links")
        emptied(last)
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
