"""Queries over graph spaces: degrees, distributions, ranked labels, neighborhoods, subgraphs.

nodes: standard_uid, node_uid, node_type, label, text_content.  edges: standard_uid, edge_uid,
edge_type, source_uid, target_uid.  Everything is computed for all spaces at once, keyed by
standard_uid; a filter on standard_uid reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.labels import match_score, node_excerpt, node_label, search_form
from graphloom.operators import trees
from graphloom.operators.adjacency import KEY, NODE, SPACE, Read, Stored, discover, endpoints
from graphloom.operators.numbered import Numbered, number
from graphloom.operators.qgrams import GramIndex, write_index
from graphloom.operators.ranks import first_rows, group_ranks
from graphloom.sources.stage import cut_lineage


def degrees(nodes: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``nodes`` with ``degree``: edge ends at the node, a self-loop counting twice; those of a stored graph have it."""
    if "degree" in nodes.columns:
        return nodes
    ends = endpoints(edges).groupBy(*KEY).agg(F.count("*").alias("degree"))
    return nodes.join(ends, KEY, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def own_degrees(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``degrees`` of a few nodes: other edge ends are not counted."""
    if "degree" in found.columns:
        return found
    ends = endpoints(edges).join(found.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("degree"))
    return found.join(ends, KEY, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``nodes``."""
    known = nodes.select(*KEY)
    for end in ("source_uid", "target_uid"):
        edges = edges.join(known.withColumnRenamed(NODE, end), [SPACE, end], "left_semi")
    return edges


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    """Distribution of a type within each space, most frequent first."""
    return rows.groupBy(SPACE, F.col(column).alias("type")).agg(F.count("*").alias("n")).orderBy(SPACE, F.desc("n"), "type")


def entries(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row a space: the type counts as a map."""
    counts = rows.groupBy(SPACE, column).agg(F.count("*").alias("n"))
    return counts.groupBy(SPACE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))


def space_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per space: node types, edge types (maps) and the number of requirements."""
    n = nodes.groupBy(SPACE).agg(F.count("*").alias("nodes"), F.count_if(F.col("node_type") == "requirement").alias("requirements"))
    e = edges.groupBy(SPACE).agg(F.count("*").alias("edges"))
    joined = n.join(e, SPACE, "left").join(entries(nodes, "node_type", "node_types"), SPACE, "left").join(entries(edges, "edge_type", "edge_types"), SPACE, "left")
    return joined.withColumn("edges", F.coalesce("edges", F.lit(0)))


def map_text(c: str) -> Column:
    """A count map as ``type=count`` entries in the order of types."""
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","), F.lit(""))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per space: totals, distinct types and the largest degree."""
    n = degrees(nodes, edges).groupBy(SPACE).agg(F.count("*").alias("nodes"), F.count_distinct("node_type").alias("node_types"), F.max("degree").alias("max_degree"))
    e = edges.groupBy(SPACE).agg(F.count("*").alias("edges"), F.count_distinct("edge_type").alias("edge_types"))
    return n.join(e, SPACE, "left").fillna(0, ["edges", "edge_types"])


def label_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).select(SPACE, NODE, node_label().alias("label"), F.coalesce("node_type", F.lit("unknown")).alias("node_type"), "degree", node_excerpt().alias("excerpt"), "text_content")


def popular_labels(nodes: DataFrame, edges: DataFrame, limit: int = 300) -> DataFrame:
    """The nodes of highest degree over all given spaces."""
    items = label_items(nodes, edges).drop("text_content")
    return items.orderBy(F.desc("degree"), F.lower("label"), SPACE, NODE).limit(limit)


def properties_text() -> Column:
    """A node's properties as JSON text, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties"))))


def write_search_index(nodes: DataFrame, path: str) -> GramIndex:
    """An index that the three searches below can use: of each node's uid, label, type, text and properties."""
    fields = [NODE, "label", "text_content"]
    more = [properties_text()] if "properties" in nodes.columns else [F.to_json(F.struct("text_content"))]
    return write_index(nodes, KEY, path, F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in fields]), F.concat_ws(" ", NODE, "label", "node_type", *more), node_label())


def search_labels(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 50, index: GramIndex | None = None) -> DataFrame:
    """Nodes that fit ``query``, by score, degree and label.  Only fitting nodes are joined with their edges."""
    needle = " ".join(query.lower().split())
    nodes = index.narrowed(nodes, needle) if index and needle else nodes
    if not needle:
        return label_items(nodes.limit(0), edges).drop("text_content").withColumn("score", F.lit(0))
    found = nodes.withColumn("score", match_score(needle)).where("score > 0")
    ends = endpoints(edges).join(found.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("degree"))
    items = found.join(ends, KEY, "left").select(
        SPACE, NODE, node_label().alias("label"), F.coalesce("node_type", F.lit("unknown")).alias("node_type"), F.coalesce("degree", F.lit(0)).alias("degree"), node_excerpt().alias("excerpt"), "score"
    )
    return items.orderBy(F.desc("score"), F.desc("degree"), F.lower("label"), SPACE, NODE).limit(limit)


def search_nodes(nodes: DataFrame, query: str, position: Sequence[Column], limit: int = 20, index: GramIndex | None = None) -> DataFrame:
    """The first ``limit`` nodes in stored order (``position``) whose uid, label or text holds ``query``."""
    needle = query.strip().lower()
    nodes = index.narrowed(nodes, needle) if index and needle else nodes
    hay = F.lower(F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in (NODE, "label", "text_content")]))
    found = nodes.where(hay.contains(needle)) if needle else nodes.limit(0)
    shown = F.coalesce(F.col("text_content"), F.col("label"), F.col(NODE))
    cut = F.when(F.length(shown) > 180, F.concat(F.substring(shown, 1, 180), F.lit("..."))).otherwise(shown)
    return found.orderBy(*position).limit(limit).select(SPACE, NODE, "node_type", F.coalesce("label", NODE).alias("label"), cut.alias("excerpt"))


def search_subgraph(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 20, index: GramIndex | None = None) -> DataFrame:
    """Search within a loaded graph, its properties as JSON included; by degree, then label."""
    needle = " ".join(query.lower().split())
    nodes = index.narrowed(nodes, needle) if index and needle else nodes
    more = properties_text() if "properties" in nodes.columns else F.to_json(F.struct("text_content"))
    hay = search_form(F.concat_ws(" ", NODE, "label", "node_type", more))
    return degrees(nodes.where(hay.contains(needle)), edges).orderBy(F.desc("degree"), node_label(), SPACE, NODE).limit(limit).select(SPACE, NODE, "node_type", "label", "degree")


def filtered_nodes(nodes: DataFrame, edges: DataFrame, types: Sequence[str], text: str = "", limit: int = 160) -> DataFrame:
    """Nodes of some types that hold ``text``, by degree."""
    needle = " ".join(text.lower().split())
    found = nodes.where(F.col("node_type").isin(*types))
    if needle:
        found = found.where(search_form(F.concat_ws(" ", "label", NODE, "text_content")).contains(needle))
    return degrees(found, edges).orderBy(F.desc("degree"), node_label(), SPACE, NODE).limit(limit).select(SPACE, NODE, "node_type", "label", "degree")


def start_nodes(nodes: DataFrame, edges: DataFrame | None, label: str | None = None, node_id: str | None = None) -> DataFrame:
    """One start node a space: by id, else equal label or uid, else part of label or text, else the root, else the first."""
    wanted = " ".join((label or "").lower().split())
    own = search_form(node_label())
    by_id = F.lit(False) if not node_id else F.col(NODE) == node_id
    some = bool(wanted) and wanted != "*"
    exact = (own == wanted) | (search_form(F.col(NODE)) == wanted) if some else F.lit(False)
    part = own.contains(wanted) | search_form(F.col("text_content")).contains(wanted) if some else F.lit(False)
    tier = F.when(by_id, 0).when(exact, 1).when(part, 2).when(F.col(NODE) == F.col(SPACE), 3).when(F.col("node_type") == "standard", 4).otherwise(5)
    ranked = (degrees(nodes, edges) if some else nodes).withColumn("tier", tier)
    matched = F.col("tier").isin(1, 2)
    by_degree = [F.when(matched, -F.col("degree")).otherwise(0), F.when(matched, F.length(node_label())).otherwise(0)] if some else []
    chosen = ranked.withColumn("r", F.row_number().over(Window.partitionBy(SPACE).orderBy("tier", *by_degree, NODE))).where("r = 1")
    return own_degrees(chosen, edges).select(SPACE, NODE, "node_type", "label", "degree", "tier")


def default_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The standard's root of each space, else its node of highest degree."""
    order = Window.partitionBy(SPACE).orderBy((F.col("node_type") != "standard").cast("int"), F.desc("degree"), NODE)
    return degrees(nodes, edges).withColumn("r", F.row_number().over(order)).where("r = 1").select(SPACE, NODE, "node_type", "degree")


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One-hop relations of every node: direction, other label; a self-loop appears once, as ``out``."""
    ends = endpoints(edges).where((F.col("direction") == "out") | (F.col(NODE) != F.col("other_uid")))
    other = nodes.select(SPACE, F.col(NODE).alias("other_uid"), node_label().alias("other_label"), F.col("node_type").alias("other_type"))
    return ends.join(other, [SPACE, "other_uid"], "left").withColumn("other_label", F.coalesce("other_label", "other_uid"))


def top_neighbors(graph: Stored | Numbered, k: int, edge_types: Sequence[str] | None = None) -> DataFrame:
    """At most k neighbors of every node, by degree, then label: standard_uid, node_uid, other_uid, r.

    Ids follow label and uid.  What a task holds of a node's neighbors is cut to k before they are compared.
    """
    graph = graph if isinstance(graph, Numbered) else number(graph.nodes, graph.edges)
    links = graph.links.where(F.col("edge_type").isin(*edge_types)) if edge_types else graph.links
    near = replace(graph, links=links).ends().where("a <> b").select("a", "b")
    near = near.join(graph.degrees().withColumnRenamed("id", "b"), "b").select("a", "b", "degree").distinct()  # by b already: no shuffle
    nearest = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("degree"), "b"))).where(F.col("r") <= k)
    nearest = graph.named(nearest.select("a", "b", "r"), "b", F.col(NODE).alias("other_uid"))
    return graph.named(nearest, "a", *KEY).select(*KEY, "other_uid", "r")


def label_exists(nodes: DataFrame, name: str, exclude: str | None = None) -> DataFrame:
    """The first node of each space with that label, if any."""
    wanted = " ".join(name.lower().split())
    found = nodes.where((search_form(node_label()) == wanted) & (F.lit(exclude).isNull() | (F.col(NODE) != F.lit(exclude))))
    return found.groupBy(SPACE).agg(F.min(NODE).alias("node_id"), F.lit(True).alias("exists"))


def breadth_first(graph: Stored | Read, starts: DataFrame, depth: int, preferred: Sequence[str] = ()) -> DataFrame:
    """Nodes within ``depth`` of each space's start, in discovery order: standard_uid, node_uid, level, seq.

    Who is discovered first follows from the finders' order and, within a node, from (preferred type,
    degree, label, uid).
    """
    kind = F.when(search_form(F.col("other_type")).isin(*[" ".join(p.lower().split()) for p in preferred]) if preferred else F.lit(False), 0).otherwise(1)
    starts = starts.select(*KEY).join(graph.nodes.select(*KEY, "chunks"), KEY)
    return discover(graph, starts, [kind, -F.col("other_degree"), F.lower("other_label")], depth).select(*KEY, "level", "seq")


def node_budget(found: DataFrame, nodes: DataFrame, most: int, preferred: Sequence[str] = ()) -> DataFrame:
    """At most ``most`` nodes a space (0: all): the start, preferred types, then the rest, each in discovery order."""
    kind = F.when(F.col("seq") == 1, 0).when(search_form(F.col("node_type")).isin(*preferred) if preferred else F.lit(False), 1).otherwise(2)
    chosen = found.join(nodes.select(*KEY, "node_type"), KEY).withColumn("rank", kind)
    if most <= 0:
        return group_ranks(chosen, [SPACE], ["rank", "seq"], "position").withColumn("truncated", F.lit(False)).drop("rank")
    total = found.groupBy(SPACE).agg((F.count("*") > most).alias("truncated"))
    return first_rows(chosen, [SPACE], ["rank", "seq"], most, NODE).join(total, SPACE).drop("rank")


def workbench(graph: Stored | Read, label: str | None = None, node_id: str | None = None, preferred: Sequence[str] = (), depth: int = 2, most: int = 220) -> tuple[DataFrame, DataFrame]:
    """(nodes, induced edges) around each space's start node; depth 1..4, at most 3000 nodes, 0: no bound."""
    depth, most = max(1, min(depth, 4)), 0 if most <= 0 else min(most, 3000)
    found = cut_lineage(breadth_first(graph, start_nodes(graph.nodes, graph.edges, label, node_id), depth, preferred))
    kept = cut_lineage(node_budget(found, graph.nodes, most, [" ".join(p.lower().split()) for p in preferred]))
    inside = graph.around(kept.select(*KEY).join(graph.nodes.select(*KEY, "chunks"), KEY), named=False).where("direction = 'out'")
    return kept, inside.join(kept.select(SPACE, F.col(NODE).alias("other_uid")), [SPACE, "other_uid"], "left_semi").select(SPACE, "edge_uid", "edge_type", F.col(NODE).alias("source_uid"), F.col("other_uid").alias("target_uid"))


def incident_subgraph(graph: Stored | Read, starts: DataFrame, depth: int = 1) -> DataFrame:
    """Edges that touch a frontier of the first ``depth`` levels (edges between two outermost nodes are not among them)."""
    frontier = cut_lineage(starts.select(*KEY).join(graph.nodes.select(*KEY, "chunks"), KEY))
    last, out = None, None
    for left in range(max(1, depth) - 1, -1, -1):
        step = cut_lineage(graph.around(frontier, named=False).select(*KEY, "other_uid", "other_chunks", "edge_uid", "edge_type", "direction"))
        out = step if out is None else out.unionByName(step)
        if left:
            reached = step.select(SPACE, F.col("other_uid").alias(NODE), F.col("other_chunks").alias("chunks")).distinct().join(frontier.select(*KEY), KEY, "left_anti")
            last, frontier = frontier, cut_lineage(reached if last is None else reached.join(last.select(*KEY), KEY, "left_anti"))
    ends = F.when(F.col("direction") == "out", F.struct(F.col(NODE).alias("source_uid"), F.col("other_uid").alias("target_uid"))).otherwise(F.struct(F.col("other_uid").alias("source_uid"), F.col(NODE).alias("target_uid")))
    return out.select(SPACE, "edge_uid", "edge_type", ends.alias("ends")).distinct().select(SPACE, "edge_uid", "edge_type", "ends.*")


def typed_neighborhood(graph: Stored | Read, starts: DataFrame, node_types: Sequence[str], edge_types: Sequence[str], depth: int, fan_out: int, focus: int = 10) -> DataFrame:
    """standard_uid, node_uid, level, focus: breadth-first over active types from one start a space.

    A node passes on to its first ``fan_out`` neighbors only, by degree in the whole graph, then label;
    the start belongs to it whatever its type.  The start and the first ``focus`` neighbors of every
    node that passed on are in focus.  Of a node of many edges each chunk picks its first neighbors
    before they are compared.
    """
    start = graph.nodes.join(starts.select(*KEY).distinct(), KEY).select(*KEY, "chunks", F.col(NODE).alias("start"), F.lit(0).alias("level"))
    order = [F.desc("other_degree"), "other_label", "other_uid"]
    first = lambda *by: F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))
    levels, seen = [cut_lineage(start)], []
    for level in range(1, depth + 1):
        ends = graph.around(levels[-1].select(*KEY, "chunks", "start"), edge_types).where(F.col("other_type").isin(*node_types) | (F.col("other_uid") == F.col("start")))
        ends = ends.select(*KEY, "chunk", "start", "other_uid", "other_label", "other_degree", "other_chunks")
        ends = ends.withColumn("r", first(*KEY, "chunk")).where(F.col("r") <= fan_out).drop("chunk", "r").distinct()
        passed = cut_lineage(ends.withColumn("r", first(*KEY)).where(F.col("r") <= fan_out).select(SPACE, F.col("other_uid").alias(NODE), F.col("other_chunks").alias("chunks"), "start", "r"))
        seen.append(passed.where(F.col("r") <= focus).select(*KEY))
        step = passed.select(*KEY, "chunks", "start").distinct()
        for old in levels:  # fan-outs are one-sided: a node may lead back to any level
            step = step.join(old.select(*KEY), KEY, "left_anti")
        levels.append(cut_lineage(step.withColumn("level", F.lit(level))))
    reached = reduce(DataFrame.unionByName, [x.select(*KEY, "level") for x in levels])
    shown = reduce(DataFrame.unionByName, seen, start.select(*KEY)).distinct().withColumn("focus", F.lit(True))
    return reached.join(shown, KEY, "left").fillna(False, ["focus"])


def edges_among(graph: Stored | Read, found: DataFrame, edge_types: Sequence[str]) -> DataFrame:
    """Edges of active types with both ends in ``found``."""
    own = graph.edges.where(F.col("edge_type").isin(*edge_types))
    for end in ("source_uid", "target_uid"):
        own = own.join(found.select(SPACE, F.col(NODE).alias(end)), [SPACE, end], "left_semi")
    return own


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Closure of ``starts`` over CONTAINS, upwards, to any height; of several parents the last one by edge_uid counts.

    Pointers to parents are doubled, so rounds follow the logarithm of the height; a cycle ends when a round adds nothing.
    """
    up = edges.where(F.upper("edge_type") == "CONTAINS").groupBy(SPACE, F.col("target_uid").alias(NODE)).agg(F.max_by("source_uid", "edge_uid").alias("up"))
    up, reached = cut_lineage(up), cut_lineage(starts.select(*KEY).distinct())
    known = reached.count()
    while True:
        reached = cut_lineage(reached.unionByName(reached.join(up, KEY).select(SPACE, F.col("up").alias(NODE))).distinct())
        last, known = known, reached.count()
        if known == last:
            return reached
        up = cut_lineage(up.join(up.select(SPACE, F.col(NODE).alias("up"), F.col("up").alias("next")), [SPACE, "up"]).select(*KEY, F.col("next").alias("up")))


def prune(graph: Stored | Numbered, node_id: str, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without a node and, until nothing changes, its neighbors left with one connection or none.

    ``roots``, by default each space's standard nodes, only go if named.  A space of which nothing
    would be left, or that hasn't the node, stays as it is.  A round looks at the neighbors of what
    went in the round before: what each of these has left is a count that only falls.
    """
    graph = graph if isinstance(graph, Numbered) else number(graph.nodes, graph.edges)
    nodes, adjacency = graph.nodes, graph.adjacency()
    roots = cut_lineage(graph.numbers(nodes.where("node_type = 'standard'") if roots is None else roots))
    around = lambda ids: adjacency.around(ids.withColumnRenamed("id", "a")).where("a <> b")
    gone = last = cut_lineage(graph.ids.where(F.col(NODE) == node_id).select("id"))
    while True:
        touched = around(last).select(F.col("b").alias("id")).distinct()
        touched = cut_lineage(touched.join(gone, "id", "left_anti").join(roots, "id", "left_anti"))
        ends = around(touched).join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        left = ends.groupBy(F.col("a").alias("id")).agg((F.min("b") < F.max("b")).alias("several")).where("several")
        last = cut_lineage(touched.join(left.select("id"), "id", "left_anti"))
        if last.isEmpty():
            break
        gone = cut_lineage(gone.unionByName(last))
    gone = cut_lineage(graph.ids.join(gone, "id", "left_semi").select(*KEY))
    kept = nodes.select(*KEY).join(gone, KEY, "left_anti")
    gone = cut_lineage(gone.join(kept.select(SPACE).distinct(), SPACE, "left_semi"))
    edges = graph.edges
    for end in ("source_uid", "target_uid"):
        edges = edges.join(gone.withColumnRenamed(NODE, end), [SPACE, end], "left_anti")
    return nodes.join(gone, KEY, "left_anti").drop("degree", "chunks"), edges.select(*graph.edges.columns)


def tree(graph: Stored | Numbered, starts: DataFrame) -> DataFrame:
    """See ``trees.tree``."""
    return trees.tree(graph, starts)


def leaf_weights(spanning: DataFrame) -> DataFrame:
    """Leaves below every reached node of a tree; a leaf weighs 1."""
    return spanning.where("weight IS NOT NULL").select(*KEY, "weight")
