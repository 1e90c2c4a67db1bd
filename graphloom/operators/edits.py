"""Edits of graph spaces as transformations of the datasets: upserts, patches, merges, removals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.labels import node_label, search_form
from graphloom.operators import merges as batches

SPACE, NODE = "standard_uid", "node_uid"
PROPERTIES = "map<string,string>"


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; some columns keep the old value over a null."""
    keys, columns = list(keys), old.columns
    a, b = old.withColumn("_in_old", F.lit(True)).alias("a"), new.select(*columns).withColumn("_in_new", F.lit(True)).alias("b")
    joined = a.join(b, keys, "full_outer")

    def pick(c: str):
        if c in keys:
            return F.col(c)
        mine, other = F.col(f"b.`{c}`"), F.col(f"a.`{c}`")
        return (F.coalesce(mine, other) if c in keep_old_if_null else F.when(F.col("b._in_new"), mine).otherwise(other)).alias(c)

    return joined.select(*[pick(c) for c in columns])


def remove(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone, list(keys), "left_anti")


def delete_document(document_id: str, jobs: DataFrame, registry: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All datasets without a document: its jobs, its registry row and the spaces that it made."""
    spaces = registry.where(F.col("document_id") == document_id).select(SPACE).distinct()
    return {
        "jobs": jobs.where(~F.col("document_id").eqNullSafe(document_id)),
        "registry": registry.where(~F.col("document_id").eqNullSafe(document_id)),
        "nodes": remove(nodes, spaces, [SPACE]),
        "edges": remove(edges, spaces, [SPACE]),
    }


def registry_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """standard_id, title, aliases: an existing title stays, aliases are the sorted union."""
    a, b = old.select("standard_id", F.col("title").alias("t0"), F.col("aliases").alias("a0")), new.select("standard_id", F.col("title").alias("t1"), F.col("aliases").alias("a1"))
    none = F.array().cast("array<string>")
    union = F.array_sort(F.array_union(F.coalesce("a0", none), F.coalesce("a1", none)))
    return a.join(b, "standard_id", "full_outer").select("standard_id", F.coalesce(F.when(F.trim("t0") != "", F.col("t0")), "t1").alias("title"), union.alias("aliases"))


def patch(rows: DataFrame, changes: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields that a change names (a map field -> value) are set, all others stay."""
    named = changes.select(*keys, F.col("fields").alias("_fields"))
    joined = rows.join(named, list(keys), "left")
    new = {f: F.when(F.coalesce(F.map_contains_key("_fields", F.lit(f)), F.lit(False)), F.col("_fields")[f]).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(new).select(*rows.columns)


def missing_targets(rows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes that name no row: the error set of a patch."""
    return changes.join(rows.select(*keys), list(keys), "left_anti")


def dangling_ends(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Edge changes whose new source or target is no node."""
    ends = changes.select("*", F.explode(F.filter(F.array(F.col("fields")["source_uid"], F.col("fields")["target_uid"]), lambda x: x.isNotNull())).alias(NODE))
    return ends.join(nodes.select(SPACE, NODE), [SPACE, NODE], "left_anti")


def find_entity(nodes: DataFrame, node_id: str | None, name: str | None) -> DataFrame:
    """The node of that id, else the first of that label or uid, per space."""
    wanted = " ".join((name or "").lower().split())
    by_id = F.col(NODE) == node_id if node_id else F.lit(False)
    by_name = (search_form(node_label()) == wanted) | (search_form(F.col(NODE)) == wanted) if wanted else F.lit(False)
    first = Window.partitionBy(SPACE).orderBy(F.when(by_id, 0).otherwise(1), NODE)
    return nodes.where(by_id | by_name).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def edit_check(nodes: DataFrame, source: DataFrame, new_label: str, allow_rename: bool, allow_merge: bool) -> DataFrame:
    """What an edit of ``source`` (one node a space) to ``new_label`` comes to: update, merge or an error."""
    wanted = " ".join(new_label.lower().split())
    twin = nodes.where(search_form(node_label()) == wanted).select(SPACE, F.col(NODE).alias("twin"))
    other = source.select(SPACE, NODE, search_form(node_label()).alias("own")).join(twin, SPACE, "left").where((F.col("twin") != F.col(NODE)) | F.col("twin").isNull())
    found = source.select(SPACE, NODE, search_form(node_label()).alias("own")).join(other.groupBy(SPACE).agg(F.min("twin").alias("twin")), SPACE, "left")
    renamed = F.col("own") != wanted
    outcome = (
        F.when(renamed & F.lit(not allow_rename), "rename_not_allowed").when(F.col("twin").isNotNull() & F.lit(not allow_merge), "exists").when(F.col("twin").isNotNull(), "merge").otherwise("update")
    )
    return found.select(SPACE, NODE, "twin", renamed.alias("renamed"), outcome.alias("outcome"))


def merge_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merges (standard_uid, source, target and, where chains matter, seq); see ``merges.merged_edges``."""
    merges = merges if "seq" in merges.columns else merges.withColumn("seq", F.lit(0).cast("long"))
    found = batches.survivors(batches.resolved(merges))
    return batches.merged_edges(edges, found.select(SPACE, NODE, "survivor"))


def merge_nodes(nodes: DataFrame, merges: DataFrame, new_label: str, new_type: str | None = None, new_text: str | None = None, new_properties: dict[str, str] | None = None) -> DataFrame:
    """Nodes after merges (standard_uid, source, target) that all edit the same; see ``merges.merge_entities``.

    The source's type, text and properties win over the target's, and what is new over both.
    """
    added = F.create_map(*[F.lit(x) for entry in (new_properties or {}).items() for x in entry]).cast(PROPERTIES)
    edited = merges.withColumns({"label": F.lit(new_label), "node_type": F.lit(new_type).cast("string"), "text_content": F.lit(new_text).cast("string"), "properties": added})
    edited = batches.resolved(edited if "seq" in merges.columns else edited.withColumn("seq", F.lit(0).cast("long")))
    return batches.merged_nodes(nodes, edited, batches.survivors(edited))


def merge_graphs(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union of two subgraphs' rows; incoming rows override, map columns are merged, current order first."""
    keys = list(key)
    a, b = current.withColumn("_from", F.lit(0)).alias("a"), incoming.alias("b")
    joined = a.join(b, keys, "full_outer")
    kinds = dict(current.dtypes)

    def pick(c: str):
        if c in keys:
            return F.col(c)
        mine, theirs = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        if kinds[c].startswith("map"):
            return F.coalesce(F.map_concat(F.map_filter(mine, lambda k, _: ~F.coalesce(F.map_contains_key(theirs, k), F.lit(False))), F.coalesce(theirs, F.create_map().cast(kinds[c]))), theirs, mine).alias(c)
        return F.coalesce(theirs, mine).alias(c)

    return joined.select(*[pick(c) for c in current.columns], F.col("_from").isNotNull().alias("was_known"))


def find_relation(edges: DataFrame, edge_id: str | None, source: str | None, target: str | None) -> DataFrame:
    """The edge of that id, else the first between the two nodes, per space."""
    by_id = F.col("edge_uid") == edge_id if edge_id else F.lit(False)
    by_ends = (F.col("source_uid") == source) & (F.col("target_uid") == target) if source and target else F.lit(False)
    first = Window.partitionBy(SPACE).orderBy(F.when(by_id, 0).otherwise(1), "edge_uid")
    return edges.where(by_id | by_ends).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def serialized(nodes: DataFrame) -> DataFrame:
    """Nodes as the workbench shows them: defaults enter the properties without overwriting."""
    shown = with_defaults(nodes, ["node_uid", "standard_uid", "text_content"])
    return nodes.select(SPACE, F.col(NODE).alias("id"), node_label().alias("label"), F.coalesce("node_type", F.lit("unknown")).alias("node_type"), shown.alias("properties"))


def serialized_edges(edges: DataFrame, of: Sequence[str] = (SPACE,)) -> DataFrame:
    """Edges as the workbench shows them: a type where there is none, the uid in the properties without overwriting."""
    text = lambda c: F.coalesce(c, F.lit(""))
    kind = F.coalesce("edge_type", F.lit("RELATED_TO"))
    return edges.select(*of, text("edge_uid").alias("id"), text("source_uid").alias("source"), text("target_uid").alias("target"), kind.alias("edge_type"), with_defaults(edges, ["edge_uid"]).alias("properties"))


def with_defaults(rows: DataFrame, columns: Sequence[str]):
    """The properties, with the given columns where these aren't null and no property has their name."""
    none = F.create_map().cast(PROPERTIES)
    defaults = F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    own = F.coalesce("properties", none) if "properties" in rows.columns else none
    return F.map_concat(own, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)))
