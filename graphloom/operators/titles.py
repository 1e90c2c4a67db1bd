"""Titles that a model decides on: requests with a tail of earlier decisions, and how the answers compare with the heuristics.

A title goes into the request of its batch and into the tails of the batches that begin shortly after
it, so one shuffle by (document, batch) makes all requests; no row of a request grows with the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import normative as N

# Chapter titles that stand for the list of cited standards, and the sizes of requests.
REFERENCE_TITLES = ["引用标准", "规范性引用文件", "引用文件"]
STANDARD_BATCH, STANDARD_TAIL = 12, 4
REPORT_BATCH, REPORT_TAIL = 36, 8
# End of fixed values.

#: Fields of a request's titles, and of the decisions in its tail.
STANDARD_TITLE = ["title_id", "title_index", "page_idx", "text", "text_normalized", "raw_title_level", "previous_title", "next_title", "previous_block_preview", "next_block_preview"]
STANDARD_DECISION = ["title_id", "page_idx", "text", "label"]
REPORT_TITLE = ["title_id", "title_index", "page_idx", "page_role", "text", "text_normalized", "raw_title_level", "previous_title", "next_title", "preceding_text_preview", "following_text_preview", "numbering_pattern"]
REPORT_DECISION = ["title_id", "text", "page_idx", "section_kind", "hierarchy_level", "is_structural", "ref"]


def with_tails(rows: DataFrame, size: int, tail: int, index: str = "title_index") -> DataFrame:
    """``rows`` (numbered from 1 per document) with ``batch`` and ``own``: once for the batch a row is in, and once for
    each batch of whose ``tail`` preceding rows it is one.  The last tails may belong to batches that don't exist."""
    before = F.col(index) - 1
    own = F.floor(before / size)
    return rows.withColumn("batch", F.explode(F.sequence(own, F.floor((before + tail) / size)))).withColumn("own", F.col("batch") == own)


def gathered(when: Column, item: Column, index: str = "title_index") -> Column:
    """Aggregate: the items of the rows for which ``when`` holds, by index."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col(index).alias("i"), item.alias("item"))))), lambda x: x["item"])


def requests(titles: DataFrame, key: str, size: int, tail: int, tail_name: str, decision: Sequence[str], item: Column) -> DataFrame:
    """key, batch, n (titles asked for), in_tail, payload: one JSON request a batch."""
    made = with_tails(titles, size, tail).groupBy(key, "batch").agg(
        F.count_if("own").alias("n"), F.count_if(~F.col("own")).alias("in_tail"),
        gathered(~F.col("own"), F.struct(*decision)).alias(tail_name), gathered(F.col("own"), item).alias("current_titles"),
    )
    payload = F.to_json(F.struct(key, tail_name, "current_titles"), {"ignoreNullFields": "false"})
    return made.where("n > 0").select(key, "batch", "n", "in_tail", payload.alias("payload"))


def standard_requests(titles: DataFrame, size: int = STANDARD_BATCH, tail: int = STANDARD_TAIL) -> DataFrame:
    """Requests to label the titles of standards.  titles: ``outline.title_inventory`` with ``label``, null while undecided."""
    names = {"index": "title_index", "prev_title": "previous_title", "prev_preview": "previous_block_preview", "next_preview": "next_block_preview"}
    return requests(titles.withColumnsRenamed(names), "standard_uid", size, tail, "previous_batch_tail", STANDARD_DECISION, F.struct(*STANDARD_TITLE))


def report_requests(titles: DataFrame, plan: DataFrame, decided: DataFrame | None = None, size: int = REPORT_BATCH, tail: int = REPORT_TAIL) -> DataFrame:
    """Requests to plan the titles of reports.  titles: ``report.title_inventory``; plan: the heuristic one, shown as a suggestion;
    decided: a plan of the same form whose entries stand in the tails, by default the heuristic one."""
    fields = {"section_kind": "kind", "hierarchy_level": "level", "is_structural": "structural", "ref": "ref"}
    entry = F.struct(*[F.col(c).alias(n) for n, c in fields.items()])
    rows = titles.join(plan.select("document_id", "pos", entry.alias("heuristic_suggestion")), ["document_id", "pos"], "left")
    if decided is None:
        rows = rows.withColumn("d", F.col("heuristic_suggestion"))
    else:
        rows = rows.join(decided.select("document_id", "pos", entry.alias("d")), ["document_id", "pos"], "left")
    return requests(rows.select("*", "d.*"), "document_id", size, tail, "previous_decisions", REPORT_DECISION, F.struct(*REPORT_TITLE, "heuristic_suggestion"))


def baseline_labels(structure: DataFrame, clauses: DataFrame) -> DataFrame:
    """standard_uid, block_id, baseline_label, baseline_source, baseline_ref, baseline_title.

    The structure node of a block (the last one, if several) says its label; a block without one that
    begins a clause is ``clause``, by the first of such clauses.  Cited standards' chapters have a label of their own.
    """
    kind = F.lower(F.trim("node_type"))
    label = F.when((kind == "chapter") & N.normalize_text(F.col("title")).isin(*REFERENCE_TITLES), "reference_standard").otherwise(kind)
    entry = lambda rank, source, what, ref, title: F.struct(F.lit(rank).alias("rank"), F.when(F.lit(rank) == 0, -F.col("pos")).otherwise(F.col("pos")).alias("at"), what.alias("baseline_label"), F.lit(source).alias("baseline_source"), F.col(ref).alias("baseline_ref"), F.col(title).alias("baseline_title"))
    nodes = structure.select("standard_uid", "block_id", entry(0, "normalized_structure", label, "ref", "title").alias("e"))
    begun = clauses.select("standard_uid", F.try_element_at("source_block_ids", F.lit(1)).alias("block_id"), entry(1, "clauses", F.lit("clause"), "clause_ref", "source_text_normalized").alias("e"))
    both = nodes.unionByName(begun).where("block_id <> ''")
    return both.groupBy("standard_uid", "block_id").agg(F.min("e").alias("e")).select("standard_uid", "block_id", "e.baseline_label", "e.baseline_source", "e.baseline_ref", "e.baseline_title")


def evaluated(titles: DataFrame, baseline: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every predicted title with both labels (``none`` without a baseline), whether they agree, and whether it reads like a contents entry.

    titles: standard_uid, title_id, page_idx, text, text_normalized; predictions: standard_uid, title_id, label, confidence, rationale.
    """
    rows = titles.select("standard_uid", "title_id", "page_idx", "text", "text_normalized").join(predictions.select("standard_uid", "title_id", F.col("label").alias("predicted_label"), "confidence", "rationale"), ["standard_uid", "title_id"])
    rows = rows.join(baseline.withColumnRenamed("block_id", "title_id"), ["standard_uid", "title_id"], "left")
    return rows.withColumns({
        "baseline_label": F.coalesce("baseline_label", F.lit("none")), "baseline_source": F.coalesce("baseline_source", F.lit("default_none")),
        "agrees": F.coalesce("baseline_label", F.lit("none")) == F.col("predicted_label"), "looks_like_toc_entry": F.col("text_normalized").rlike(r"(?U)\s\d+\s*$"),
    })


def mismatches(rows: DataFrame) -> DataFrame:
    return rows.where("NOT agrees").select("standard_uid", "title_id", "page_idx", "text", "baseline_label", "predicted_label", "confidence", "rationale", "baseline_source", "baseline_ref", "looks_like_toc_entry")


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """titles, exact matches and their rate (four digits, ties to even), the two kinds of semantic upgrade; per ``by``, or of all rows."""
    base, own = F.col("baseline_label"), F.col("predicted_label")
    return rows.groupBy(*by).agg(
        F.count("*").alias("titles"), F.count_if("agrees").alias("exact_matches"), F.coalesce(F.bround(F.count_if("agrees") / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("exact_match_rate"),
        F.count_if((base == "chapter") & (own == "reference_standard")).alias("chapter_to_reference_standard"), F.count_if(base.isin("chapter", "section") & (own == "none") & F.col("looks_like_toc_entry")).alias("heading_to_none_with_page_suffix"),
    )


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "baseline_label", "predicted_label").agg(F.count("*").alias("n"))
