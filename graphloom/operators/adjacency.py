"""Graphs as stored tables: each node's edges, with what traversals ask of the other end.

Written once, bucketed by node, so that a frontier comes to the adjacency and not the other way
round.  The edges of a node of very many are split into chunks, which are part of the key: a frontier
row stands once for each chunk of its node.  That pays for traversals of many levels; those of a few
read the edges themselves a level at a time (``Read``) and look up no more than what they find.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.labels import node_label
from graphloom.operators.ranks import group_ranks
from graphloom.sources.stage import bucketed, cut_lineage

SPACE, NODE = "standard_uid", "node_uid"
KEY = [SPACE, NODE]
#: Edge ends of a node in a chunk; parts of a node's ends where edges are read as they are.
CHUNK, PARTS = 10_000, 64


@dataclass
class Stored:
    """nodes: all their columns and degree, chunks.  near: a row an edge end - standard_uid, node_uid,
    chunk, other_uid, edge_uid, edge_type, direction, known (are both ends nodes?), and of the other
    end other_type, other_label, other_degree, other_chunks.  edges: as given."""

    nodes: DataFrame
    edges: DataFrame
    near: DataFrame

    def around(self, frontier: DataFrame, edge_types: Sequence[str] | None = None, named: bool = True) -> DataFrame:
        """Edge ends of the frontier (standard_uid, node_uid, chunks, ...), whose other columns stay; ``named``: those between known nodes."""
        near = self.near.where(F.col("edge_type").isin(*edge_types)) if edge_types else self.near
        return around(frontier, near.where("known") if named else near)


@dataclass
class Read:
    """nodes: all their columns and chunks, which is 1.  edges: as given.  Both are written, nothing else is."""

    nodes: DataFrame
    edges: DataFrame

    def around(self, frontier: DataFrame, edge_types: Sequence[str] | None = None, named: bool = True) -> DataFrame:
        """As of a stored graph; types, labels and degrees of other ends (``named``) are worked out for these ends alone."""
        edges = self.edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else self.edges
        ends = endpoints(edges).join(frontier.drop("chunks"), KEY).withColumns({"chunk": F.pmod(F.hash("other_uid", "edge_uid"), F.lit(PARTS)), "other_chunks": F.lit(1)})
        if not named:
            return ends
        ends = cut_lineage(ends)
        found = ends.select(SPACE, F.col("other_uid").alias(NODE)).distinct()
        found = cut_lineage(self.nodes.join(found, KEY, "left_semi").select(*KEY, F.col("node_type").alias("other_type"), node_label().alias("other_label")))
        degrees = endpoints(self.edges).select(*KEY).join(found.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("other_degree"))
        return ends.join(found.join(degrees, KEY).withColumnRenamed(NODE, "other_uid"), [SPACE, "other_uid"])


def read(nodes: DataFrame, edges: DataFrame) -> Read:
    """``nodes`` and ``edges`` for traversals of few levels."""
    return Read(cut_lineage(nodes).withColumn("chunks", F.lit(1)), cut_lineage(edges))


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge twice, from either end: (standard_uid, node_uid, other_uid, edge_uid, edge_type, direction)."""
    rest = ["edge_uid", "edge_type"]
    out = edges.select(SPACE, F.col("source_uid").alias(NODE), F.col("target_uid").alias("other_uid"), *rest, F.lit("out").alias("direction"))
    return out.unionByName(edges.select(SPACE, F.col("target_uid").alias(NODE), F.col("source_uid").alias("other_uid"), *rest, F.lit("in").alias("direction")))


def store(nodes: DataFrame, edges: DataFrame, chunk: int = CHUNK) -> Stored:
    """``nodes`` and ``edges`` (or what is stored of them already) as tables that traversals read."""
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    ends = endpoints(edges)
    counts = ends.groupBy(*KEY).agg(F.count("*").alias("degree"))
    shown = nodes.select(*KEY, F.col("node_type").alias("type"), node_label().alias("label"), F.lit(True).alias("known"))
    vertices = shown.join(counts, KEY, "full_outer").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("degree") / chunk)).cast("int"))
    vertices = cut_lineage(vertices)
    other = vertices.select(SPACE, F.col(NODE).alias("other_uid"), F.col("known").alias("known_b"), F.col("type").alias("other_type"), F.col("label").alias("other_label"), F.col("degree").alias("other_degree"), F.col("chunks").alias("other_chunks"))
    own = vertices.select(*KEY, F.col("known").alias("known_a"), "chunks")
    near = ends.join(other, [SPACE, "other_uid"]).join(own, KEY).withColumn("chunk", F.pmod(F.hash("other_uid", "edge_uid"), F.col("chunks")))
    near = near.withColumn("known", F.col("known_a").isNotNull() & F.col("known_b").isNotNull()).drop("known_a", "known_b", "chunks")
    with_degree = nodes.join(vertices.select(*KEY, "degree", "chunks"), KEY)
    return Stored(bucketed(with_degree, KEY, "nodes"), edges, bucketed(near, [*KEY, "chunk"], "near"))


def around(frontier: DataFrame, near: DataFrame) -> DataFrame:
    """``near`` of the frontier (standard_uid, node_uid, chunks, ...), a row an edge end; other columns of the frontier stay."""
    spread = frontier.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return spread.join(near, [*KEY, "chunk"])


def discover(graph: Stored | Read, starts: DataFrame, order: Sequence[Column], depth: int | None = None) -> DataFrame:
    """standard_uid, node_uid, parent, level, seq of all that can be reached from each space's start, edges in both directions.

    starts: standard_uid, node_uid, chunks, one a space.  ``seq`` numbers a space's nodes from 1 in the
    order in which a queue would find them: by the finder's number, then ``order`` (columns of edge ends),
    then uid.  A neighbor is at most one level away, so only the last two levels are looked at again.
    """
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    columns = [SPACE, NODE, "parent", "level", "seq"]
    frontier = cut_lineage(starts.select(*KEY, "chunks", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("seq")))
    levels, level = [frontier], 0
    while depth is None or level < depth:
        level += 1
        step = graph.around(frontier.select(*KEY, "chunks", F.col("seq").alias("from_seq"))).select(*KEY, "from_seq", "other_uid", "other_chunks", *keys)
        for seen in levels[-2:]:
            step = step.join(seen.select(SPACE, F.col(NODE).alias("other_uid")), [SPACE, "other_uid"], "left_anti")
        first = F.min(F.struct("from_seq", *names, F.col(NODE).alias("parent"), "other_chunks")).alias("o")
        found = step.groupBy(SPACE, "other_uid").agg(first).select(SPACE, F.col("other_uid").alias(NODE), "o.*")
        ranked = group_ranks(found, [SPACE], ["from_seq", *names, NODE])
        base = levels[-1].groupBy(SPACE).agg(F.max("seq").alias("base"))
        frontier = cut_lineage(ranked.join(base, SPACE).select(*KEY, F.col("other_chunks").alias("chunks"), "parent", F.lit(level).alias("level"), (F.col("base") + F.col("rank")).alias("seq")))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0].select(*columns)
    for found in levels[1:]:
        out = out.unionByName(found.select(*columns))
    return out
