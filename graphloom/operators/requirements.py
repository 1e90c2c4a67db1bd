"""Requirements from clauses: list items under an introduction, or sentences with a modal verb."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import normative as N
from graphloom.operators.ranks import first_rows

DOC = "standard_uid"


def candidates(clauses: DataFrame) -> DataFrame:
    """One row a requirement text, in order within its clause, with the modality that it inherits."""
    text = F.col("source_text_normalized")
    whole = N.modality(text)
    by_list = (F.size("list_items") > 0) & (whole.isNotNull() | N.any_of(text, N.LIST_INTRO))
    clauses = clauses.withColumn("intro", F.when(by_list, N.item_intro(F.substring_index(text, "\n", 1)))).withColumn("inherited", whole)  # once a clause, not once an item
    intro, whole = F.col("intro"), F.col("inherited")
    listed = F.transform("list_items", lambda i: F.struct(N.requirement_under(intro, i["text_normalized"]).alias("requirement_text"), i["text_normalized"].alias("source"), whole.alias("modality"), F.lit(True).alias("soft"), F.lit(0.82).cast("double").alias("split_confidence")))
    soft, split = text.contains("；") | text.contains("。"), F.when(text.contains("；"), F.lit(0.74)).otherwise(F.lit(0.9)).cast("double")
    pieces = F.filter(F.transform(N.sentences(text), lambda s: F.struct(s.alias("requirement_text"), text.alias("source"), N.modality(s).alias("modality"), soft.alias("soft"), split.alias("split_confidence"))), lambda x: x["modality"].isNotNull())
    return clauses.select("*", F.posexplode(F.when(intro.isNotNull(), listed).otherwise(pieces)).alias("i", "r")).drop("intro", "inherited")


def requirements(clauses: DataFrame) -> DataFrame:
    clauses = clauses.withColumn("tags", N.domain_tags(F.col("heading_path"), F.col("source_text_normalized")))
    rows = candidates(clauses).select("*", "r.*").drop("r")
    text = F.col("requirement_text")
    return rows.select(
        DOC, "pos", F.col("clause_uid").alias("parent_clause_uid"), "clause_ref", F.concat(F.col("clause_uid"), F.lit("#r"), (F.col("i") + 1).cast("string")).alias("requirement_uid"),
        "requirement_text", F.coalesce("modality", N.modality(text), F.lit("must")).alias("modality"), N.subject(text).alias("subject"), F.array(N.action(text)).alias("action"),
        N.objects(text).alias("object"), N.applicability(text).alias("applicability_rule"), F.array(F.concat(F.lit("应在报告或资料中体现："), text)).alias("judgement_criteria"),
        N.evidence(text).alias("evidence_expected"), F.col("tags").alias("domain_tags"), N.cited_targets(N.citations(text)).alias("cited_targets"),
        F.col("soft").alias("is_soft_split"), F.round("split_confidence", 2).alias("split_confidence"), F.round(F.least("segmentation_confidence", "split_confidence"), 2).alias("confidence"),
        F.col("i").alias("ordinal"),
    )


def from_items(clauses: DataFrame, items: DataFrame) -> DataFrame:
    """Requirements from items of a model (clause_uid, requirements array, maybe concepts), gaps filled by the heuristics.

    An item's requirement: requirement_text, modality, subject, action[], object[], evidence_expected[],
    cited_targets[], confidence, and maybe applicability_rule, judgement_criteria[], domain_tags[].
    Blank texts are dropped before numbering.
    """
    none = F.array().cast(N.STRINGS)
    known = items.schema["requirements"].dataType.elementType.fieldNames()
    own = items.select(DOC, "clause_uid", "requirements", (F.col("concepts") if "concepts" in items.columns else none).alias("concepts"))
    rows = clauses.drop("concepts").join(own, [DOC, "clause_uid"]).select("*", F.posexplode("requirements").alias("i", "r"))
    text = N.normalize_text(F.col("r.requirement_text"))
    rows = rows.withColumn("t", text).where("t <> ''")
    t, r = F.col("t"), F.col("r")
    nth = F.row_number().over(Window.partitionBy(DOC, "clause_uid").orderBy("i"))
    or_else = lambda own, other: F.when(F.size(F.coalesce(own, none)) > 0, own).otherwise(other)
    listed = lambda name: F.coalesce(r[name], none) if name in known else none
    rule = N.blank_to_null(r["applicability_rule"]) if "applicability_rule" in known else F.lit(None).cast("string")
    confidence = N.clamp(r["confidence"], 0.82)
    return rows.select(
        DOC, F.col("clause_uid").alias("parent_clause_uid"), "clause_ref", F.concat(F.col("clause_uid"), F.lit("#r"), nth.cast("string")).alias("requirement_uid"), t.alias("requirement_text"),
        F.coalesce(N.blank_to_null(r["modality"]), N.modality(t), F.lit("must")).alias("modality"), F.coalesce(N.blank_to_null(r["subject"]), N.subject(t)).alias("subject"),
        or_else(N.dedupe_strings(or_else(r["action"], F.array(N.action(t)))), F.array(t)).alias("action"), N.dedupe_strings(or_else(r["object"], N.objects(t))).alias("object"),
        F.coalesce(rule, N.applicability(t)).alias("applicability_rule"), N.dedupe_strings(or_else(listed("judgement_criteria"), F.array(F.concat(F.lit("应在报告或资料中体现："), t)))).alias("judgement_criteria"),
        N.dedupe_strings(or_else(r["evidence_expected"], N.evidence(t))).alias("evidence_expected"),
        N.dedupe_strings(F.concat(listed("domain_tags"), F.coalesce("concepts", none), N.domain_tags(F.col("heading_path"), F.col("source_text_normalized")))).alias("domain_tags"),
        N.merge_targets(r["cited_targets"], N.cited_targets(N.citations(t)), N.cited_targets(N.citations(F.col("source_text_normalized")))).alias("cited_targets"),
        ((F.size("requirements") > 1) | (F.size("list_items") > 0)).alias("is_soft_split"),
        F.round(confidence, 2).alias("split_confidence"), F.round(F.least("segmentation_confidence", confidence), 2).alias("confidence"),
    )


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``rows`` with the number of the request that each goes into, per standard."""
    nth = F.row_number().over(Window.partitionBy(DOC).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(nth / size).cast("int"))


def returned_or_failed(asked: DataFrame, returned: DataFrame, key: str = "clause_uid") -> tuple[DataFrame, DataFrame]:
    """(rows with their returned item, rows that nothing came back for)."""
    return asked.join(returned, [DOC, key], "inner"), asked.join(returned, [DOC, key], "left_anti")


def with_fallback(clauses: DataFrame, items: DataFrame) -> DataFrame:
    """Model requirements where an item came back, the heuristic ones for all other clauses."""
    common = [DOC, "parent_clause_uid", "clause_ref", "requirement_uid", "requirement_text", "modality", "subject", "action", "object", "applicability_rule", "judgement_criteria", "evidence_expected", "domain_tags", "cited_targets", "is_soft_split", "split_confidence", "confidence"]
    model, rest = from_items(clauses, items), clauses.join(items.select(DOC, "clause_uid"), [DOC, "clause_uid"], "left_anti")
    return model.select(*common, F.lit("model").alias("path")).unionByName(requirements(rest).select(*common, F.lit("heuristic").alias("path")))


def counts_by_clause(clauses: DataFrame, found: DataFrame) -> DataFrame:
    n = found.groupBy(DOC, F.col("parent_clause_uid").alias("clause_uid")).agg(F.count("*").alias("requirement_count"))
    return clauses.select(DOC, "clause_uid").join(n, [DOC, "clause_uid"], "left").fillna(0)


def request_payloads(clauses: DataFrame, size: int = 6) -> DataFrame:
    """One JSON request a batch of clauses: where each stands, its text and the texts of its list items."""
    text = F.coalesce(N.blank_to_null(F.col("source_text_normalized")), F.col("source_text"))
    items = F.transform("list_items", lambda i: F.coalesce(N.blank_to_null(i["text_normalized"]), i["text"]))
    own = F.struct("clause_uid", "clause_ref", "heading_path", "chapter_ref", "section_ref", text.alias("source_text_normalized"), items.alias("list_items"))
    numbered = batches(clauses, size, "pos")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", own.alias("c")))), lambda x: x["c"])
    return numbered.groupBy(DOC, "batch").agg(F.count("*").alias("n"), listed.alias("clauses")).select(DOC, "batch", "n", F.to_json(F.struct(DOC, "clauses"), {"ignoreNullFields": "false"}).alias("payload"))


def details(found: DataFrame, clauses: DataFrame) -> DataFrame:
    """What is shown of each requirement: its standard (from its own id), texts, citations and the spans of pages that it comes from.

    ``found`` and ``clauses`` meet by the clause, in equal partitions of (standard, clause); a requirement of an unknown clause has no spans.
    """
    boxes = F.col("source_bbox") if "source_bbox" in clauses.columns else F.lit(None).cast("array<double>")
    spans = clauses.select(DOC, F.col("clause_uid").alias("parent_clause_uid"), F.array(F.struct(F.array("first_page", "last_page").alias("page_span"), boxes.alias("bbox"))).alias("source_spans"))
    rows = found.join(spans, [DOC, "parent_clause_uid"], "left")
    return rows.select(
        F.col("requirement_uid").alias("requirement_id"), standard_of(F.col("requirement_uid")).alias("standard_id"), "clause_ref", "requirement_text", "modality", "applicability_rule",
        "judgement_criteria", "evidence_expected", F.col("cited_targets").alias("citations"), F.coalesce("source_spans", F.array().cast("array<struct<page_span:array<int>,bbox:array<double>>>")).alias("source_spans"),
    )


def standard_of(requirement_uid: Column) -> Column:
    """The standard's id, code and year, that a requirement's id begins with; null if it has no more parts than that."""
    return F.when(F.size(F.split(requirement_uid, ":")) > 2, F.substring_index(requirement_uid, ":", 2))


def linked(edges: DataFrame, nodes: DataFrame | None = None, most: int = 12) -> DataFrame:
    """standard_uid, node_uid, linked, first: how many requirements derive from each node, and the first ``most`` of them by id.

    With ``nodes``, clauses without any count 0.  The first are chosen within parts of a node's requirements before they meet, so no task holds them all.
    """
    own = edges.where("edge_type = 'DERIVES_REQUIREMENT'").select(DOC, F.col("source_uid").alias("node_uid"), "target_uid").distinct()
    counts = own.groupBy(DOC, "node_uid").agg(F.count("*").alias("linked"))
    ranked = first_rows(own, [DOC, "node_uid"], ["target_uid"], most, "target_uid")
    first = ranked.groupBy(DOC, "node_uid").agg(F.array_sort(F.collect_list("target_uid")).alias("first"))
    rows = counts.join(first, [DOC, "node_uid"])
    if nodes is None:
        return rows
    every = nodes.where("node_type = 'clause'").select(DOC, "node_uid").join(rows, [DOC, "node_uid"], "left")
    return every.select(DOC, "node_uid", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("first", F.array().cast(N.STRINGS)).alias("first"))
