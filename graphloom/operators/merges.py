"""Merges of entities in batches: chains and fans of merges come to one survivor, in the order of their numbers.

A merge puts its source over its target: the source's properties, type, label and text win, and what
the merge's own edit says wins over both.  A node that has gone stands for what it went into.  So the
merges form trees, with later merges into a node above earlier ones, and who wins over whom is a
pre-order number, found by pointer doubling; values are then chosen by aggregation, one property at a
time, however many nodes meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.labels import node_label, present
from graphloom.operators.adjacency import KEY, NODE, SPACE
from graphloom.operators.ranks import group_ranks, running_sums
from graphloom.operators.trees import doubled
from graphloom.sources.stage import cut_lineage

PROPERTIES = "map<string,string>"
EDIT = {"label": "string", "node_type": "string", "text_content": "string", "properties": PROPERTIES}
LISTS = ("merged_aliases", "merged_node_ids")


def with_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``rows`` with nulls for the columns that they lack."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in rows.columns})


def pointers(merges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(for each k: standard_uid, node_uid, up, most - the 2^k-th node that a node goes into, and the last merge on the way there; the nodes on cycles)."""
    step = cut_lineage(merges.select(SPACE, F.col("source").alias(NODE), F.col("target").alias("up"), F.col("seq").alias("most")))
    n, levels = step.count(), []
    while not step.isEmpty():
        levels.append(step)
        if 2 ** (len(levels) - 1) >= n:
            return levels, step.select(SPACE, F.col("up").alias(NODE)).distinct()
        further = step.select(SPACE, F.col(NODE).alias("up"), F.col("up").alias("next"), F.col("most").alias("later"))
        step = cut_lineage(step.join(further, [SPACE, "up"]).select(*KEY, F.col("next").alias("up"), F.greatest("most", "later").alias("most")))
    return levels, step.select(*KEY)


def resolved(merges: DataFrame) -> DataFrame:
    """Merges that take place (standard_uid, source, target, seq, ...), targets being what stands for them at that time.

    Of several merges of one source the first counts.  Merges of a node with what it already stands in
    go: that is the last one of each cycle.
    """
    merges = merges.where("source <> target")
    first = merges.groupBy(SPACE, "source").agg(F.min("seq").alias("seq"))
    merges = cut_lineage(merges.join(first, [SPACE, "source", "seq"]))
    levels, cycles = pointers(merges)
    if not cycles.isEmpty():
        last = levels[-1].join(cycles, KEY).select(SPACE, F.col(NODE).alias("source"), F.col("most").alias("seq"))
        merges = cut_lineage(merges.join(last, [SPACE, "source", "seq"], "left_anti"))
        levels, _ = pointers(merges)
    for step in reversed(levels):  # past all nodes that have gone before
        by = step.select(SPACE, F.col(NODE).alias("target"), F.col("up").alias("next"), "most")
        moved = merges.join(by, [SPACE, "target"], "left")
        merges = cut_lineage(moved.withColumn("target", F.when(F.col("most") < F.col("seq"), F.col("next")).otherwise(F.col("target"))).drop("next", "most"))
    return merges


def survivors(merges: DataFrame) -> DataFrame:
    """standard_uid, node_uid, survivor, precedence, edit_precedence of all nodes in ``resolved`` merges; higher values win."""
    sources = merges.select(SPACE, F.col("source").alias(NODE), F.col("target").alias("parent"), "seq")
    roots = merges.select(SPACE, F.col("target").alias(NODE)).distinct().join(sources.select(*KEY), KEY, "left_anti")
    forest = cut_lineage(sources.unionByName(roots.select(*KEY, F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("seq"))))
    sizes, hops = doubled(forest)
    children = group_ranks(forest.where("parent IS NOT NULL").join(sizes.select(*KEY, "size"), KEY), [SPACE, "parent"], ["seq", NODE])
    placed = running_sums(children, [SPACE, "parent"], "rank", "size", "before").select(*KEY, (F.col("before") + 1).alias("position"), F.col("parent").alias("top"))
    placed = cut_lineage(placed.unionByName(roots.select(*KEY, F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("top"))))
    for up in hops:
        above = up.join(placed.select(SPACE, F.col(NODE).alias("up"), F.col("position").alias("more"), F.coalesce("top", NODE).alias("higher")), [SPACE, "up"]).select(*KEY, "more", "higher")
        placed = cut_lineage(placed.join(above, KEY, "left").select(*KEY, (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"), F.coalesce("higher", "top").alias("top")))
    last = F.col("position") + F.col("size") - 1
    return placed.join(sizes, KEY).select(*KEY, F.coalesce("top", NODE).alias("survivor"), (2 * F.col("position")).alias("precedence"), (2 * last + 1).alias("edit_precedence"))


def best(value: Column, name: str) -> Column:
    """The value of the highest precedence, nulls apart."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("precedence"))).alias(name)


def merge_entities(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after merges: standard_uid, source, target, seq and what each edits (label, node_type, text_content, properties).

    Survivors list the labels and ids of all that went into them, and the lists of an earlier merge of
    the highest one that has any.  Merges that name unknown nodes don't take place.
    """
    known = nodes.select(*KEY)
    for end in ("source", "target"):
        merges = merges.join(known.withColumnRenamed(NODE, end), [SPACE, end], "left_semi")
    merges = resolved(with_columns(merges, EDIT))
    found = cut_lineage(survivors(merges))
    return merged_nodes(nodes, merges, found), merged_edges(edges, found.select(SPACE, NODE, "survivor"))


def merged_nodes(nodes: DataFrame, merges: DataFrame, found: DataFrame) -> DataFrame:
    full = with_columns(nodes, {"properties": PROPERTIES} | dict.fromkeys(LISTS, "array<string>"))
    mine = full.join(found, KEY).select(
        SPACE, "survivor", F.col(NODE).alias("uid"), "precedence", F.lit(False).alias("edit"), node_label().alias("label"),
        F.coalesce("node_type", F.lit("unknown")).alias("node_type"), present(F.col("text_content")).alias("text_content"), "properties", *LISTS,
    )
    places = found.select(SPACE, F.col(NODE).alias("source"), "survivor", F.col("edit_precedence").alias("precedence"))
    edits = merges.join(places, [SPACE, "source"]).select(
        SPACE, "survivor", F.lit(None).cast("string").alias("uid"), "precedence", F.lit(True).alias("edit"), F.trim(present(F.col("label"))).alias("label"),
        F.trim(present(F.col("node_type"))).alias("node_type"), present(F.col("text_content")).alias("text_content"), "properties", *[F.lit(None).cast("array<string>").alias(c) for c in LISTS],
    )
    parts = cut_lineage(mine.unionByName(edits))
    by = [SPACE, "survivor"]
    chosen = parts.groupBy(*by).agg(
        *[best(F.col(c), c) for c in ("label", "node_type", "text_content", *LISTS)], F.collect_set("label").alias("labels"), F.collect_set("uid").alias("uids")
    )
    entries = parts.select(*by, "precedence", F.explode("properties").alias("k", "v"))
    values = entries.groupBy(*by, "k").agg(F.max_by("v", "precedence").alias("v"))
    maps = values.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    none = F.array().cast("array<string>")
    united = lambda own, earlier: F.array_sort(F.array_distinct(F.concat(own, F.coalesce(earlier, none))))
    info = chosen.join(maps, by, "left").select(
        SPACE, F.col("survivor").alias(NODE), F.col("label").alias("_label"), F.col("node_type").alias("_type"), F.coalesce("text_content", F.lit("")).alias("_text"), F.col("properties").alias("_properties"),
        F.filter(united(F.col("labels"), F.col("merged_aliases")), lambda a: (a != F.col("label")) & (a != "")).alias("_aliases"), united(F.col("uids"), F.col("merged_node_ids")).alias("_ids"),
    )
    left = full.join(found.where(f"{NODE} <> survivor").select(*KEY), KEY, "left_anti").join(info, KEY, "left")
    merged = F.col("_ids").isNotNull()
    new = {"label": "_label", "node_type": "_type", "text_content": "_text", "properties": "_properties", "merged_aliases": "_aliases", "merged_node_ids": "_ids"}
    shown = [c for c in full.columns if c in nodes.columns or c in LISTS]
    return left.withColumns({c: F.when(merged, F.col(v)).otherwise(F.col(c)) for c, v in new.items()}).select(*shown)


def merged_edges(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges after ``moved`` (standard_uid, node_uid, survivor): ends rewritten, loops dropped, duplicates folded.

    Of edges with the same ends and type the first by uid stays; the others' uids are listed, and
    their ``properties``, where edges have such a map, fill in what the ones before them lack.
    """
    for end in ("source_uid", "target_uid"):
        by = moved.select(SPACE, F.col(NODE).alias(end), F.col("survivor").alias("_to"))
        edges = edges.join(by, [SPACE, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    kept = edges.where("source_uid <> target_uid").withColumn("edge_type", F.coalesce("edge_type", F.lit("RELATED_TO")))
    key = [SPACE, "source_uid", "target_uid", "edge_type"]
    folded = kept.groupBy(*key).agg(F.min("edge_uid").alias("edge_uid"), F.array_sort(F.collect_set("edge_uid")).alias("all"))
    folded = folded.select(SPACE, "edge_uid", "edge_type", "source_uid", "target_uid", F.array_except("all", F.array("edge_uid")).alias("merged_edge_ids"))
    if "properties" not in edges.columns:
        return folded
    values = kept.select(*key, "edge_uid", F.explode("properties").alias("k", "v")).groupBy(*key, "k").agg(F.min_by("v", "edge_uid").alias("v"))
    maps = values.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return folded.join(maps, key, "left").withColumn("properties", F.coalesce("properties", F.create_map().cast(PROPERTIES)))


# The names under which an edit gives a label, a type or a text; all others are properties.
ENTITY_FIELDS = {"label": ["entity_name", "label"], "node_type": ["entity_type", "node_type"], "text_content": ["description", "text_content"]}
RELATION_FIELDS = {"edge_type": ["relation_type", "edge_type", "label"]}
# End of fixed values.


def named(keys: list[str], blank_too: bool):
    return lambda k, v: k.isin(keys) & (F.lit(blank_too) | (F.trim(v) != ""))


def normalized_edits(edits: DataFrame, names: dict[str, list[str]], texts: tuple[str, ...] = ("text_content",)) -> DataFrame:
    """``edits`` (..., fields: map<string,string>, properties) with a column for each of ``names``, and all unknown fields in ``properties``.

    Fields without value count as not given; labels and types are trimmed and blank ones not given.
    Of several names for one thing the last in the map counts, and a field wins over an explicit property.
    """
    edits = with_columns(edits, {"properties": PROPERTIES})
    given = F.map_filter(F.coalesce("fields", F.create_map().cast(PROPERTIES)), lambda _, v: v.isNotNull())
    columns = {}
    for column, own in names.items():
        found = F.map_entries(F.map_filter(given, named(own, blank_too=column in texts)))
        value = F.try_element_at(found, F.lit(-1))["value"]
        columns[column] = value if column in texts else F.trim(value)
    unknown = F.map_filter(given, lambda k, _: ~k.isin([n for own in names.values() for n in own] + ["properties"]))
    explicit = F.coalesce("properties", F.create_map().cast(PROPERTIES))
    columns["properties"] = F.map_concat(F.map_filter(explicit, lambda k, _: ~F.map_contains_key(unknown, k)), unknown)
    return edits.withColumns(columns).drop("fields")


def edit_relations(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges after edits (standard_uid, edge_uid, fields, properties): type replaced, properties added to."""
    new = normalized_edits(edits, RELATION_FIELDS).select(SPACE, "edge_uid", F.col("edge_type").alias("_type"), F.col("properties").alias("_more"))
    rows = with_columns(edges, {"properties": PROPERTIES}).join(new, [SPACE, "edge_uid"], "left")
    own = F.coalesce("properties", F.create_map().cast(PROPERTIES))
    added = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key("_more", k)), F.col("_more"))
    edited = F.col("_more").isNotNull()
    return rows.withColumns({"edge_type": F.when(edited, F.coalesce("_type", "edge_type", F.lit("RELATED_TO"))).otherwise(F.col("edge_type")), "properties": F.when(edited, added).otherwise(F.col("properties"))}).drop("_type", "_more")


def edit_entities(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Nodes after edits (standard_uid, node_uid, fields, properties) that merge nothing."""
    new = normalized_edits(edits, ENTITY_FIELDS).select(*KEY, F.struct("label", "node_type", "text_content", "properties").alias("_new"))
    rows = with_columns(nodes, {"properties": PROPERTIES}).join(new, KEY, "left")
    own, more = F.coalesce("properties", F.create_map().cast(PROPERTIES)), F.col("_new.properties")
    values = {
        "label": F.coalesce("_new.label", node_label()),
        "node_type": F.coalesce("_new.node_type", "node_type", F.lit("unknown")),
        "text_content": F.coalesce("_new.text_content", "text_content", F.lit("")),
        "properties": F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(more, k)), more),
    }
    edited = F.col("_new").isNotNull()
    return rows.withColumns({c: F.when(edited, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_new")
