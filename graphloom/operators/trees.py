"""Breadth-first trees with pre-order numbers, without paths.

Discovery over a numbered graph gives each node its parent and its place in the queue, a level at a
time.  Sizes of subtrees and their leaves go up the same levels, pre-order numbers come down again, so
that every node is handled once each way.  Siblings stand next to each other in the queue, so what
comes before a node among them is a difference of running sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.adjacency import KEY, NODE, SPACE, Stored
from graphloom.operators.numbered import Numbered, in_order, number
from graphloom.operators.ranks import group_ranks, running_sums
from graphloom.sources.stage import cut_lineage

# What a node's type holds -> its rank, in the order of looking; others come last.
TYPE_RANKS = {"chapter": 1, "section": 2, "clause": 3, "appendix": 4, "require": 5}
OTHER_TYPES, CITED, REQUIRED, RELATED, INBOUND = 6, 16, 8, 12, 2
# End of fixed values.


def type_rank(node_type: Column) -> Column:
    rank = F.lit(OTHER_TYPES)
    for part, n in reversed(TYPE_RANKS.items()):
        rank = F.when(F.lower(node_type).contains(part), n).otherwise(rank)
    return rank


def neighbor_priority(edge_type: Column, outbound: Column, node_type: Column) -> Column:
    """Which neighbors a tree takes first: contained ones by type, requirements, other relations by type, citations."""
    kind, node_type = F.upper(F.coalesce(edge_type, F.lit(""))), F.coalesce(node_type, F.lit(""))
    inbound = F.when(outbound, 0).otherwise(INBOUND)
    return (
        F.when(kind == "CONTAINS", type_rank(node_type))
        .when(kind.isin("REFERENCES", "CITES"), CITED + inbound)
        .when(F.lower(node_type).contains("require"), REQUIRED + inbound)
        .otherwise(RELATED + inbound + type_rank(node_type))
    )


def doubled(tree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(standard_uid, node_uid, size, weight; the pointers of every round): descendants with the node itself, and leaves among them."""
    inner = tree.select(SPACE, F.col("parent").alias(NODE)).where(f"{NODE} IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    own = tree.select(*KEY, F.col("parent").alias("up")).join(inner, KEY, "left").select(*KEY, "up", F.lit(1).cast("long").alias("size"), F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("weight"))
    own, hops = cut_lineage(own), []
    while True:
        moving = own.where("up IS NOT NULL")
        if moving.isEmpty():
            return own.drop("up"), hops
        hops.append(moving.select(*KEY, "up"))
        below = moving.groupBy(SPACE, F.col("up").alias(NODE)).agg(F.sum("size").alias("more"), F.sum("weight").alias("leaves"))
        further = moving.select(SPACE, F.col(NODE).alias("up"), F.col("up").alias("next"))
        moved = moving.select(*KEY, "up").join(further, [SPACE, "up"]).select(*KEY, "next")
        own = cut_lineage(
            own.drop("up").join(below, KEY, "left").join(moved, KEY, "left")
            .select(*KEY, F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("weight") + F.coalesce("leaves", F.lit(0))).alias("weight"))
        )


def discovered(graph: Numbered, starts: DataFrame) -> list[DataFrame]:
    """The levels around the starts' ids (one a space) in both directions: id, parent, seq.

    ``seq`` follows the order in which a queue would find a level's nodes: by the finder's number, then
    priority, label and uid.  A neighbor is at most one level away, so only the last two levels are looked at again.
    """
    adjacency = graph.adjacency()
    levels = [cut_lineage(starts.select("id", F.lit(None).cast("long").alias("parent"), F.col("id").alias("seq")))]
    while True:
        step = adjacency.around(levels[-1].select(F.col("id").alias("a"), F.col("seq").alias("from_seq")))
        found = step.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("from_seq", "rank", F.col("a").alias("parent"))).alias("o")).select("id", "o.*")
        for seen in levels[-2:]:
            found = found.join(seen.select("id"), "id", "left_anti")
        found = in_order(found, ["from_seq", "rank", "id"], "seq").select("id", "parent", "seq")
        if found.isEmpty():
            return levels
        levels.append(found)


def measured(levels: list[DataFrame]) -> DataFrame:
    """id, parent, level, position, size, weight: sizes and leaves come up a level at a time, positions go down again."""
    sized, below = [], None
    for found in reversed(levels):
        own = found.withColumns({"more": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "first": F.lit(None).cast("long")}) if below is None else found.join(below, "id", "left")
        own = cut_lineage(own.select("id", "parent", "seq", (1 + F.coalesce("more", F.lit(0))).alias("size"), F.coalesce("leaves", F.lit(1)).alias("weight"), "first"))
        own = cut_lineage(running_sums(own, [], "seq", "size", "sum").drop("seq"))
        below = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("more"), F.sum("weight").alias("leaves"), F.min("sum").alias("first"))
        sized.append(own)
    placed = [cut_lineage(sized[-1].select("id", "parent", F.lit(0).alias("level"), F.lit(0).cast("long").alias("position"), "size", "weight", "first"))]
    for level, own in enumerate(reversed(sized[:-1]), 1):
        up = placed[-1].select(F.col("id").alias("parent"), F.col("position").alias("up"), F.col("first").alias("from"))
        placed.append(cut_lineage(own.join(up, "parent").select("id", "parent", F.lit(level).alias("level"), (F.col("up") + 1 + F.col("sum") - F.col("from")).alias("position"), "size", "weight", "first")))
    return reduce(DataFrame.unionByName, placed).drop("first")


def tree(graph: Stored | Numbered, starts: DataFrame) -> DataFrame:
    """standard_uid, node_uid, parent, level, position, size, weight of all nodes, as a tree from each space's start.

    Edges count in both directions; a node's neighbors come by ``neighbor_priority``, label and uid.
    ``position`` numbers the pre-order from 0; ``weight`` is the number of leaves below, 1 for a leaf.
    Nodes that can't be reached come last, by label and uid, one level each below the deepest, without
    parent, size and weight.  In a space without a start all nodes have level 0 and come by uid.
    """
    graph = graph if isinstance(graph, Numbered) else number(graph.nodes, graph.edges, neighbor_priority)
    found = measured(discovered(graph, graph.numbers(starts)))
    found = graph.named(found, "parent", F.col(NODE).alias("parent_uid"), how="left").withColumnRenamed("parent_uid", "parent")
    reached = cut_lineage(found.join(graph.ids.select("id", *KEY), "id").select("id", *KEY, "parent", "level", "position", "size", "weight"))
    ends = reached.groupBy(SPACE).agg(F.max("level").alias("deepest"), F.count("*").alias("count"))
    left = graph.ids.select("id", *KEY, "label").join(reached.select("id"), "id", "left_anti").drop("id").join(ends, SPACE, "left")
    left = group_ranks(left.withColumn("label", F.when(F.col("count").isNotNull(), F.col("label")).otherwise("")), [SPACE], ["label", NODE])
    none = F.lit(None)
    rest = left.select(
        *KEY, none.cast("string").alias("parent"), F.coalesce(F.col("deepest") + F.col("rank"), F.lit(0)).cast("int").alias("level"),
        (F.coalesce("count", F.lit(0)) + F.col("rank") - 1).alias("position"), none.cast("long").alias("size"), none.cast("long").alias("weight"),
    )
    return reached.select(*rest.columns).unionByName(rest)
