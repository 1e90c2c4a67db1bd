"""Outline of normative standards: title acceptance, structure nodes, clauses - as window functions.

Blocks: standard_uid, page_idx, block_idx, item_idx, source_type, text (and table_caption).  The
sequential reading of a standard becomes running counts and carried-forward structs, all within
``partitionBy(standard_uid)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import normative as N

DOC = "standard_uid"
ORDER = ["page_idx", "block_idx", "item_idx"]


def by() -> Window:
    """The rows of a document in order."""
    return Window.partitionBy(DOC).orderBy("pos")


def so_far() -> Window:
    return by().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def normalized_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with ``pos`` (their order), block_id and text_normalized."""
    caption = F.col("table_caption") if "table_caption" in blocks.columns else F.when(F.col("source_type") == "table", F.col("text"))
    pos = F.row_number().over(Window.partitionBy(DOC).orderBy(*ORDER))
    out = blocks.withColumns({"pos": pos, "block_id": N.block_id(F.col("page_idx"), F.col("block_idx"), F.col("item_idx")), "text_normalized": N.normalize_text(F.col("text")), "table_caption": caption})
    return out.withColumn("text", N.strip(F.col("text")))


def title_inventory(blocks: DataFrame) -> DataFrame:
    """Titles in order with their neighbors: previous and next title, and the texts of the blocks around."""
    level = F.col("raw_title_level") if "raw_title_level" in blocks.columns else F.lit(None).cast("int")
    around = blocks.withColumns({"raw_title_level": level, "prev_text": F.lag("text_normalized").over(by()), "next_text": F.lead("text_normalized").over(by())})
    titles = around.where("source_type = 'title'")
    return titles.select(
        DOC, "pos", "page_idx", F.col("block_id").alias("title_id"), F.row_number().over(by()).alias("index"), "text", "text_normalized", "raw_title_level", F.lag("text_normalized").over(by()).alias("prev_title"),
        F.lead("text_normalized").over(by()).alias("next_title"), F.col("prev_text").alias("prev_preview"), F.col("next_text").alias("next_preview"),
    )


def with_decisions(blocks: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Blocks with ``info`` of their titles: decided labels (standard_uid, title_id, label) or the heuristic."""
    if decisions is None:
        return blocks.withColumns({"info": F.when(F.col("source_type") == "title", N.title_info(F.col("text_normalized"))), "decided": F.lit(False)})
    named = decisions.select(DOC, F.col("title_id").alias("block_id"), "label")
    joined = blocks.join(named, [DOC, "block_id"], "left")
    return joined.withColumns({"info": F.when(F.col("source_type") == "title", N.decided_title(F.col("label"), F.col("text_normalized"))), "decided": F.lit(True)}).drop("label")


def outline(blocks: DataFrame) -> DataFrame:
    """Every block with what holds at it: segment, accepted title, body kind, appendix, chapter, section.

    A segment begins at each clause start; within it titles are accepted from the first one on
    that would be accepted on its own, since that one closes the clause.
    """
    text, info = F.col("text_normalized"), F.col("info")
    rows = blocks.withColumn("clause_ref", F.when(info.isNull(), N.group_or_null(text, N.CLAUSE, 1)))
    rows = rows.withColumns({"segment": F.count("clause_ref").over(so_far()), "current_ref": F.last("clause_ref", ignorenulls=True).over(so_far()), "next_type": F.lead("source_type").over(by()), "next_norm": F.lead("text_normalized").over(by())})
    number, current = info["ref"].try_cast("long"), F.substring_index("current_ref", ".", 1).try_cast("long")
    looks_inline = N.inline_title(text, F.col("next_type"), F.col("next_norm"))
    rejected = (info["node_type"] == "chapter") & (F.col("segment") > 0) & ~F.col("decided") & F.coalesce((number < current) | ((number != current) & looks_inline), F.lit(False))
    within = Window.partitionBy(DOC, "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("accepted_so_far", F.coalesce(F.max((info.isNotNull() & ~rejected).cast("int")).over(within), F.lit(0)))
    rows = rows.withColumn("accepted", info.isNotNull() & ((F.col("segment") == 0) | (F.col("accepted_so_far") == 1)))
    ref = F.coalesce(info["ref"], F.col("block_id"))
    uid = F.concat(F.col(DOC), F.lit(":"), info["node_type"], F.lit(":"), F.replace(F.lower(ref), F.lit("附录"), F.lit("appendix-")))
    node = F.struct("pos", uid.alias("uid"), info["node_type"].alias("node_type"), info["ref"].alias("ref"), info["title"].alias("title"), F.col("block_id").alias("block_id"))
    kind = lambda *k: F.last(F.when(F.col("accepted") & info["node_type"].isin(*k), node), ignorenulls=True).over(so_far())
    rows = rows.withColumns({"appendix": kind("appendix"), "chapter": kind("chapter", "reference_standard"), "section": kind("section")})
    after = lambda a, b: F.when(F.coalesce(a["pos"] > b["pos"], F.lit(True)), a)
    rows = rows.withColumn("body_kind", F.when(F.col("appendix").isNotNull(), "appendix").when(F.col("chapter").isNotNull(), "main").otherwise("front_matter"))
    rows = rows.withColumn("chapter", after(F.col("chapter"), F.col("appendix"))).withColumn("section", after(F.col("section"), F.col("appendix")))
    # a section belongs to the chapter before it; a later chapter ends it
    last_chapter = F.last(F.when(F.col("accepted") & info["node_type"].isin("chapter", "reference_standard"), F.col("pos")), ignorenulls=True).over(so_far())
    rows = rows.withColumn("section", F.when(F.coalesce(F.col("section.pos") > last_chapter, F.lit(True)), F.col("section")))
    opened = (F.col("segment") > 0) & (F.col("accepted_so_far") == 0)
    return rows.withColumn("in_clause", opened)


def structure_nodes(rows: DataFrame) -> DataFrame:
    """Accepted titles as nodes with their parent: section under chapter, else appendix; appendix chapters under it."""
    kind = F.col("info.node_type")
    parent = F.when(kind == "section", F.coalesce("chapter.uid", "appendix.uid")).when(kind.isin("chapter", "reference_standard") & (F.col("body_kind") == "appendix"), F.col("appendix.uid"))
    own = F.when(kind == "appendix", F.col("appendix")).when(kind == "section", F.col("section")).otherwise(F.col("chapter"))
    return rows.where("accepted").select(DOC, "pos", own["uid"].alias("node_uid"), kind.alias("node_type"), "info.ref", "info.title", F.col("text_normalized").alias("raw_text"), parent.alias("parent_uid"), "page_idx", "block_id")


def clause_uid() -> Column:
    scope = F.when(F.col("body_kind") == "main", "main").when(F.col("body_kind") == "appendix", F.concat(F.lit("appendix-"), F.lower(F.coalesce("appendix.ref", "appendix.block_id")))).otherwise("front")
    return F.concat_ws(":", F.col(DOC), scope, F.col("clause_ref"))


def clauses(rows: DataFrame) -> DataFrame:
    """One row a clause: references, texts in order, pages, list items, tables, confidence."""
    text, is_start = F.col("text_normalized"), F.col("clause_ref").isNotNull()
    is_table = ~is_start & (F.col("source_type") == "table")
    item = F.when(F.col("source_type") == "list_item", N.group_or_null(text, N.LIST_ITEM, 1)).when(F.col("source_type") == "paragraph", N.group_or_null(text, N.PARAGRAPH_ITEM, 1))
    item_text = F.when(F.col("source_type") == "list_item", F.regexp_extract(text, N.LIST_ITEM, 2)).otherwise(F.regexp_extract(text, N.PARAGRAPH_ITEM, 2))
    is_item = ~is_start & ~is_table & item.isNotNull()
    members = rows.where("in_clause").withColumns({
        "is_start": is_start, "is_table": is_table, "is_item": is_item, "item_ref": item, "item_text": F.coalesce(N.blank_to_null(N.strip(item_text)), text),
        "part": F.when(is_table, F.col("table_caption")).otherwise(F.col("text")), "part_normalized": F.when(is_table, N.normalize_text(F.col("table_caption"))).otherwise(text),
    })
    ordered = lambda c, when=None: F.transform(F.array_sort(F.collect_list(F.when(when if when is not None else F.lit(True), F.struct("pos", c.alias("v"))))), lambda x: x["v"])
    first = lambda c: F.first(F.when(F.col("is_start"), c), ignorenulls=True)
    grouped = members.groupBy(DOC, "segment").agg(
        F.min("pos").alias("pos"), first(clause_uid()).alias("clause_uid"), first(F.col("body_kind")).alias("body_kind"), first(F.col("appendix.ref")).alias("appendix_ref"),
        first(F.col("chapter.ref")).alias("chapter_ref"), first(F.col("section.ref")).alias("section_ref"), first(F.col("clause_ref")).alias("clause_ref"),
        first(F.coalesce("section.uid", "chapter.uid")).alias("parent_uid"),
        first(F.filter(F.array("appendix.title", "chapter.title", "section.title"), lambda x: F.coalesce(x, F.lit("")) != "")).alias("heading_path"),
        F.array_join(ordered(F.col("part"), F.coalesce(F.col("part"), F.lit("")) != ""), "\n").alias("source_text"), F.array_join(ordered(F.col("part_normalized"), F.coalesce(F.col("part_normalized"), F.lit("")) != ""), "\n").alias("source_text_normalized"),
        F.min("page_idx").alias("first_page"), F.max("page_idx").alias("last_page"), ordered(F.col("block_id")).alias("source_block_ids"),
        ordered(F.struct("item_ref", F.col("text").alias("text"), F.col("item_text").alias("text_normalized"), "block_id"), F.col("is_item")).alias("list_items"),
        ordered(F.struct(F.col("table_caption").alias("caption"), "block_id", "page_idx"), F.col("is_table")).alias("tables"),
        F.count_if(~F.col("is_start") & ~F.col("is_table") & ~F.col("is_item")).alias("continuations"),
    )
    confidence = N.segmentation_confidence(F.col("continuations") > 0, F.col("body_kind") == "appendix", F.size("source_block_ids"))
    with_tables = F.transform("tables", lambda t, i: F.struct(F.concat(F.col("clause_uid"), F.lit("#table"), (i + 1).cast("string")).alias("table_uid"), (i + 1).alias("table_index"), t["caption"].alias("caption"), N.table_ref(t["caption"]).alias("table_ref"), t["block_id"].alias("block_id"), t["page_idx"].alias("page_idx")))
    return grouped.withColumns({"segmentation_confidence": confidence, "tables": with_tables}).drop("segment")


def standard_metrics(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per standard: blocks, nodes, clauses by kind, tables, rejected titles, orphans, continuations."""
    by_block = rows.groupBy(DOC).agg(
        F.count("*").alias("blocks"), F.count_if("accepted").alias("structure_nodes"), F.count_if(F.col("info").isNotNull() & ~F.col("accepted")).alias("rejected_titles"),
        F.count_if(~F.col("accepted") & ~F.col("in_clause") & (F.col("text_normalized") != "")).alias("orphans"),
    )
    by_clause = found.groupBy(DOC).agg(
        F.count("*").alias("clauses"), F.count_if(F.col("body_kind") == "main").alias("main_clauses"), F.count_if(F.col("body_kind") == "appendix").alias("appendix_clauses"),
        F.sum(F.size("tables")).alias("tables"), F.sum("continuations").alias("continuations"),
    )
    return by_block.join(by_clause, DOC, "left").fillna(0)


def duplicate_clauses(found: DataFrame) -> DataFrame:
    return found.groupBy(DOC, "clause_uid").agg(F.count("*").alias("n")).where("n > 1")


def eligible(found: DataFrame, include_appendix: bool = False) -> DataFrame:
    """Clauses that requirements are extracted from; front matter never."""
    return found.where(F.col("body_kind").isin("main", *["appendix"] * include_appendix))
