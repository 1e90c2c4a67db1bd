"""Report-versus-standard comparison: statuses, coverage, routing, hierarchy, comparison graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.labels import natural_key, node_label, search_form
from graphloom.operators import edits
from graphloom.operators.graph import KEY, NODE, SPACE, ancestors, degrees, inner_edges
from graphloom.operators.qgrams import substring_pairs
from graphloom.operators.ranks import group_ranks
from graphloom.sources.stage import cut_lineage, wide_rows

# The spellings of each status, the worst first in priority.
STATUS_FORMS = {
    "violated": ["violated", "violation", "non_compliant", "not_satisfied", "冲突", "违反", "不满足", "不符合"],
    "covered": ["covered", "cover", "covered_fully", "satisfied", "compliant", "满足", "符合", "已覆盖", "覆盖"],
    "partial": ["partial", "partially_covered", "partially_satisfied", "partially_compliant", "部分覆盖", "部分满足", "部分符合"],
    "missing": ["missing", "not_covered", "uncovered", "absent", "缺失", "未覆盖", "未体现"],
    "not_applicable": ["not_applicable", "not-applicable", "n/a", "na", "不适用", "无关"],
}
PRIORITY = ["violated", "covered", "partial", "missing", "not_applicable"]
# End of fixed values.


def status_table(spark: SparkSession) -> DataFrame:
    """(form, status): a few dozen rows."""
    return spark.createDataFrame([(form, status) for status, forms in STATUS_FORMS.items() for form in forms], "form string, status string")


def with_status(items: DataFrame, raw: str = "raw_status") -> DataFrame:
    """``status`` from its spelling; spellings that are not known stay as they are, normalized."""
    items = items.withColumn("form", F.replace(search_form(F.col(raw)), F.lit(" "), F.lit("_")))
    known = F.broadcast(status_table(items.sparkSession))
    return items.join(known, "form", "left").withColumn("status", F.coalesce("status", "form")).drop("form")


def worst_status(status: Column) -> Column:
    """The aggregate: violated, else covered, partial, missing, else not applicable."""
    rank = F.lit(len(PRIORITY) - 1)
    for i, s in reversed(list(enumerate(PRIORITY))):
        rank = F.when(status == s, i).otherwise(rank)
    return F.element_at(F.array(*[F.lit(s) for s in PRIORITY]), F.min(rank) + 1)


def coverage(status: Column) -> Column:
    """(covered + half of partial) over applicable, four places; 0 without any."""
    applicable = F.count_if(F.coalesce(status, F.lit("")) != "not_applicable")
    points = F.sum(F.when(status == "covered", 1.0).when(status == "partial", 0.5).otherwise(0.0).cast("double"))
    return F.when(applicable > 0, F.round(points / applicable, 4)).otherwise(F.lit(0.0)).cast("double")


def status_summary(status: Column) -> Column:
    shown = ["covered", "partial", "missing", "violated", "not_applicable"]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{s}="), F.count_if(status == s).cast("string")) for s in shown])


def comparable(items: DataFrame) -> DataFrame:
    return items.where("status <> 'not_applicable'")


def item_details(items: DataFrame, clauses: DataFrame) -> DataFrame:
    """Comparison items with what is known of their clauses; items of unknown clauses go."""
    return items.join(clauses, "clause_id").withColumn("label", F.coalesce("label", "clause_id"))


def unit_results(items: DataFrame) -> DataFrame:
    """Per unit: coverage score and summary of its items."""
    return items.groupBy("unit_uid").agg(coverage(F.col("status")).alias("coverage_score"), status_summary(F.col("status")).alias("summary"))


def resolved_score(model_score: Column, own: Column) -> Column:
    """The model's score if it gave one other than 0, within 0..1, else our own."""
    value = model_score.try_cast("double")
    return F.when(value != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(own)


def clause_results(items: DataFrame, clauses: DataFrame) -> DataFrame:
    """Per clause over all units: status, distinct reasons in order, first evidence."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.struct("unit_uid", "item_order", F.trim(c).alias("v"))))), lambda x: x["v"])
    evidence = F.col("evidence") if "evidence" in items.columns else F.lit(None).cast("string")
    grouped = items.withColumn("evidence", evidence).groupBy("clause_id").agg(
        worst_status(F.col("status")).alias("status"), F.substring(F.array_join(F.array_distinct(ordered(F.col("reason"))), " | "), 1, 2000).alias("reason"),
        F.try_element_at(ordered(F.col("evidence")), F.lit(1)).alias("evidence"),
    )
    return grouped.join(clauses, "clause_id", "left").withColumn("label", F.coalesce("label", "clause_id")).withColumn("sort_key", natural_key(F.col("clause_ref"), F.col("clause_id")))


def matched_ids(items: DataFrame, clauses: DataFrame) -> DataFrame:
    """Per unit the sorted sets of sections and chapters that its items touch."""
    return items.join(clauses, "clause_id").groupBy("unit_uid").agg(F.array_sort(F.collect_set("section_id")).alias("sections"), F.array_sort(F.collect_set("chapter_id")).alias("chapters"))


def chosen_clauses(clauses: DataFrame, sections: DataFrame) -> DataFrame:
    """Candidate clauses of chosen sections (unit_uid, section_id): one row a unit and clause."""
    return sections.join(clauses, "section_id").select("unit_uid", "clause_id", "section_id", "chapter_id")


def chosen_counts(clauses: DataFrame, sections: DataFrame) -> DataFrame:
    """unit_uid, section_id, n: how many ``chosen_clauses`` a unit has in each section; clauses are counted a section before they meet the units."""
    counts = clauses.groupBy("section_id").agg(F.count("*").alias("n"))
    return sections.groupBy("unit_uid", "section_id").agg(F.count("*").alias("times")).join(counts, "section_id").select("unit_uid", "section_id", (F.col("n") * F.col("times")).alias("n"))


def routed(units: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units with their scope's route, units without one)."""
    return units.join(scopes, "parent_uid"), units.join(scopes, "parent_uid", "left_anti")


def parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    inside = inner_edges(nodes, edges.where(F.upper("edge_type") == "CONTAINS"))
    return inside.groupBy(SPACE, F.col("target_uid").alias(NODE)).agg(F.max_by("source_uid", "edge_uid").alias("parent"))


def hierarchy(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """chapters, sections (a chapter without any stands in as ``chapter_scope``) and clauses with both ids."""
    kind = nodes = cut_lineage(nodes.select(*KEY, "node_type", node_label().alias("label")))  # read once for each level and end
    up = cut_lineage(parents(nodes, edges))
    chapters = kind.where("node_type = 'chapter'").select(SPACE, F.col(NODE).alias("id"), "label")
    sections = kind.where("node_type = 'section'").join(up, KEY, "left").select(SPACE, F.col(NODE).alias("id"), F.col("parent").alias("chapter_id"), "label", F.lit("section").alias("scope_type"))
    bare = chapters.join(sections.select(SPACE, F.col("chapter_id").alias("id")), [SPACE, "id"], "left_anti")
    sections = sections.unionByName(bare.select(SPACE, "id", F.col("id").alias("chapter_id"), "label", F.lit("chapter_scope").alias("scope_type")))
    above = kind.select(SPACE, F.col(NODE).alias("parent"), F.col("node_type").alias("parent_type"))
    grand = up.select(SPACE, F.col(NODE).alias("parent"), F.col("parent").alias("grand"))
    own = kind.where("node_type = 'clause'").join(up, KEY, "left").join(above, [SPACE, "parent"], "left").join(grand, [SPACE, "parent"], "left")
    chapter = F.when(F.col("parent_type") == "section", F.col("grand")).when(F.col("parent_type") == "chapter", F.col("parent"))
    section = F.when(F.col("parent_type") == "section", F.col("parent"))
    clauses = own.select(SPACE, F.col(NODE).alias("id"), F.coalesce(section, chapter).alias("section_id"), chapter.alias("chapter_id"), "label")
    return {"chapters": chapters, "sections": sections, "clauses": clauses}


def resolve_ids(values: DataFrame, aliases: DataFrame, structural: str = r"[:0-9]") -> DataFrame:
    """Free-form ids (unit_uid, position, value) to candidates (id, alias, alias_order).

    Equal aliases are an equi-join.  What is left is compared with structural aliases: a value may
    begin with the alias and a separator, or hold the id anywhere, within a word too; both are found
    by the pieces of its text.  First by value position, exact before the others, then alias order.
    """
    norm = lambda c: search_form(F.col(c))
    values = values.withColumn("v", norm("value")).where("v <> ''")
    known = aliases.withColumn("a", norm("alias")).where("a <> ''")
    known = known.groupBy("a").agg(F.min(F.struct("alias_order", "id")).alias("o")).select("a", "o.id", "o.alias_order")
    exact = values.join(known, F.col("v") == F.col("a")).select("unit_uid", "position", "id", "alias_order", F.lit(0).alias("tier"))
    rest = values.join(exact.select("unit_uid", "position"), ["unit_uid", "position"], "left_anti")
    parts = known.where(F.col("a").rlike(structural)).select("a", "id", "alias_order", F.explode(F.array_distinct(F.array("a", F.lower("id")))).alias("needle"))
    held = substring_pairs(F.col("v"), rest, F.col("needle"), parts)
    begins = F.col("needle") == F.lower("id")
    for separator in (" ", ":", "-"):
        begins = begins | F.col("text").startswith(F.concat("a", F.lit(separator)))
    first = held.join(parts, "needle").where(begins).groupBy("text").agg(F.min(F.struct("alias_order", "id")).alias("o"))
    part = rest.join(first.withColumnRenamed("text", "v"), "v").select("unit_uid", "position", "o.id", "o.alias_order", F.lit(1).alias("tier"))
    best = exact.unionByName(part).groupBy("unit_uid").agg(F.min(F.struct("position", "tier", "alias_order", "id")).alias("o"))
    return best.select("unit_uid", "o.id", "o.tier")


def comparison_graph(nodes: DataFrame, edges: DataFrame, items: DataFrame, statuses: Sequence[str] = ("covered", "partial", "missing", "violated")) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a comparison: judged clauses with all above them, and a status edge per item.

    items: standard_uid, unit_uid, node_uid (the clause), status, reason.
    """
    judged = items.where(F.col("status").isin(*statuses))
    above = ancestors(edges, judged)
    unit = F.concat(F.lit("report-compare:"), F.col("unit_uid"))
    own = nodes.join(above, KEY, "left_semi").select(*KEY, "node_type", node_label().alias("label"))
    units = judged.select(SPACE, unit.alias(NODE), F.lit("report_unit").alias("node_type"), F.lit("Report Unit").alias("label")).distinct()
    kept = inner_edges(own, edges.where(F.upper("edge_type") == "CONTAINS")).select(SPACE, "edge_type", "source_uid", "target_uid")
    marks = judged.select(SPACE, F.upper("status").alias("edge_type"), unit.alias("source_uid"), F.col(NODE).alias("target_uid"))
    return own.unionByName(units), kept.unionByName(marks)


#: Statuses that draw an edge from a unit to a clause.
JUDGED = ("covered", "partial", "missing", "violated")


def above(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """standard_uid, node_uid, up: every node over each of ``starts`` by CONTAINS, of any height; pairs are doubled from round to round."""
    inside = ancestors(edges, starts)
    up = parents(nodes, edges).join(inside, KEY, "left_semi").where(F.col("parent") != F.col(NODE))
    pairs, known = cut_lineage(up.select(*KEY, F.col("parent").alias("up"))), -1
    while (n := pairs.count()) > known:
        known = n
        further = pairs.select(SPACE, F.col(NODE).alias("up"), F.col("up").alias("next"))
        pairs = cut_lineage(pairs.unionByName(pairs.join(further, [SPACE, "up"]).select(*KEY, F.col("next").alias("up"))).distinct())
    return pairs.join(starts.select(*KEY).distinct(), KEY, "left_semi")


def unit_graphs(nodes: DataFrame, edges: DataFrame, items: DataFrame, units: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the comparison of every report unit with a standard, as the workbench shows them.

    items: standard_uid, document_id, unit_uid, position (from 1), node_uid, status, reason, evidence.  units: document_id,
    unit_uid, text, section_path.  matched: standard_uid, document_id, unit_uid, node_uid of matched chapters and sections.
    A graph holds the unit, the standard's root, what is matched, judged clauses and all above them; CONTAINS between
    these; and an edge by status for each judged item, with its reason and evidence.
    """
    of = ["document_id", "unit_uid", SPACE]
    judged = items.where(F.col("status").isin(*JUDGED))
    pairs = items.select(*of).unionByName(matched.select(*of)).distinct()
    clauses = cut_lineage(judged.select(*of, NODE).distinct())
    over = clauses.join(above(nodes, edges, clauses), KEY).select(*of, F.col("up").alias(NODE))
    held = pairs.select(*of, F.col(SPACE).alias(NODE)).unionByName(matched.select(*of, NODE)).unionByName(clauses).unionByName(over).distinct()
    known = nodes if "properties" in nodes.columns else nodes.withColumn("properties", F.create_map().cast(edits.PROPERTIES))
    shown = edits.serialized(known).join(degrees(nodes, edges).select(SPACE, F.col(NODE).alias("id"), "degree"), [SPACE, "id"])
    held = cut_lineage(held.join(nodes.select(*KEY), KEY, "left_semi"))
    own = held.withColumnRenamed(NODE, "id").join(shown, [SPACE, "id"])
    unit = F.concat_ws(":", F.lit("report-compare"), "document_id", "unit_uid")
    texts = F.map_filter(F.create_map(F.lit("document_id"), F.col("document_id"), F.lit("unit_uid"), F.col("unit_uid"), F.lit("text_content"), F.coalesce("text", F.lit("")), F.lit("section_path"), F.to_json(F.coalesce("section_path", F.array().cast("array<string>")))), lambda _, v: v.isNotNull())
    roots = pairs.join(units.select("document_id", "unit_uid", "text", "section_path"), ["document_id", "unit_uid"], "left").select(*of, unit.alias("id"), F.lit("Report Unit").alias("label"), F.lit("report_unit").alias("node_type"), texts.alias("properties"), F.lit(0).cast("long").alias("degree"))
    contains = edges.where(F.upper("edge_type") == "CONTAINS")
    # from below: a node has few parents, but a root's children are many
    inner = held.withColumnRenamed(NODE, "target_uid").join(contains, [SPACE, "target_uid"]).join(held.withColumnRenamed(NODE, "source_uid"), [*of, "source_uid"], "left_semi")
    kept = edits.serialized_edges(inner, of)
    marks = judged.select(
        *of, F.concat(F.lit("report-compare-edge:"), F.col("position").cast("string")).alias("id"), unit.alias("source"), F.col(NODE).alias("target"), F.upper("status").alias("edge_type"),
        F.map_filter(F.create_map(F.lit("reason"), F.col("reason"), F.lit("report_evidence"), F.col("evidence")), lambda _, v: v.isNotNull()).alias("properties"),
    )
    return roots.unionByName(own.select(*roots.columns)), kept.select(*marks.columns).unionByName(marks)


def resolved_unit_scores(payloads: DataFrame, items: DataFrame) -> DataFrame:
    """unit_uid, coverage_score, summary: the score that a model gave with its payload (unit_uid, model_score), else that of the unit's items."""
    own = unit_results(items)
    joined = payloads.select("unit_uid", "model_score").join(own, "unit_uid", "full_outer")
    return joined.select("unit_uid", resolved_score(F.col("model_score"), F.coalesce("coverage_score", F.lit(0.0))).alias("coverage_score"), "summary")


def report_scope() -> Column:
    """What a request shows of a report's unit; columns as in ``scope_requests``."""
    return F.struct("unit_uid", "title", "section_path", "structural_path", "text", "page_span")


#: Units that share a body in a chunk; entries of a body that are gathered at once.
SHARE, PIECE = 1000, 4096


def scope_entries(sets: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """standard_uid, body and the columns of the scopes that each set (standard_uid, body, ids) holds."""
    named = sets.select(SPACE, "body", F.explode("ids").alias("_key"))
    return named.join(scopes.withColumn("_key", F.col(key)), [SPACE, "_key"]).drop("_key")


def listed(entries: DataFrame) -> Column:
    """The aggregate: a body's entries by id, as a JSON list."""
    return F.to_json(F.array_sort(F.collect_set(F.struct(*[c for c in entries.columns if c not in (SPACE, "body", "_rank")]))), {"ignoreNullFields": "false"})


def scope_texts(entries: DataFrame, views: Sequence[Column] = ()) -> DataFrame:
    """standard_uid, body, candidates, inside, ...: what each body holds, by id, as the inside of a JSON list, and ``views`` of it.

    Entries meet in pieces of ``PIECE``, and a body's pieces as texts: no task has all of a body's entries as rows.
    """
    fields = [c for c in entries.columns if c not in (SPACE, "body")]
    placed = group_ranks(entries.distinct(), [SPACE, "body"], fields, "_rank")
    pieces = placed.groupBy(SPACE, "body", F.floor((F.col("_rank") - 1) / PIECE).alias("_piece")).agg(F.count("*").alias("n"), listed(placed).alias("piece"))
    shown = pieces.select(SPACE, "body", "_piece", "n", F.expr("substring(piece, 2, length(piece) - 2)").alias("inside"), *views)
    texts = shown.columns[4:]
    whole = shown.groupBy(SPACE, "body").agg(F.sum("n").cast("int").alias("candidates"), F.array_sort(F.collect_list(F.struct("_piece", *texts))).alias("_pieces"))
    return whole.select(SPACE, "body", "candidates", *[F.array_join(F.col("_pieces")[c], ",").alias(c) for c in texts])


def chosen_sets(chosen: DataFrame, key: str, name: str) -> DataFrame:
    """standard_uid, unit_uid and, as ``name``, the ids that each unit chose, in order."""
    return chosen.groupBy(SPACE, "unit_uid").agg(F.array_sort(F.collect_set(key)).alias(name))


def scope_bodies(units: DataFrame, levels: dict[str, DataFrame], chapters: DataFrame | None, sections: DataFrame | None, views: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(standard_uid, unit_uid, body; standard_uid, body, candidates, lists, ...): units by what they chose, and the lists of every different choice as JSON."""
    wide_rows(units.sparkSession)
    ids, heads = [], {}
    if chapters is None:
        members = units.select(SPACE, "unit_uid", F.lit("").alias("body")).distinct()
        name, entries = "candidate_chapters", levels["chapters"].withColumn("body", F.lit(""))
    else:
        members, ids = chosen_sets(chapters, "chapter_id", "chapters"), ["chapters"]
        if sections is not None:
            members, ids = chosen_sets(sections, "section_id", "sections").join(members, [SPACE, "unit_uid"], "left"), ["chapters", "sections"]
        members = cut_lineage(members.withColumn("body", F.sha2(F.to_json(F.struct(*ids)), 256)))
        sets = members.groupBy(SPACE, "body").agg(*[F.first(c).alias(c) for c in ids])
        of = lambda c: sets.select(SPACE, "body", F.col(c).alias("ids"))
        heads = {"selected_chapters": scope_entries(of("chapters"), levels["chapters"], "id")}
        if sections is None:
            name, entries = "candidate_sections", scope_entries(of("chapters"), levels["sections"], "chapter_id")
        else:
            heads["selected_sections"] = scope_entries(of("sections"), levels["sections"], "id")
            name, entries = "candidate_clauses", scope_entries(of("sections"), levels["clauses"], "section_id")
    bodies = scope_texts(entries, views)
    shown = bodies.columns[4:]
    for head, own in heads.items():  # no longer than the choice, which is a row's
        bodies = bodies.join(own.groupBy(SPACE, "body").agg(listed(own).alias(head)), [SPACE, "body"], "left")
    fields = [F.concat(F.lit(f'"{head}":'), F.coalesce(head, F.lit("[]"))) for head in heads]
    lists = F.concat(F.lit("{"), F.concat_ws(",", *fields, F.concat(F.lit(f'"{name}":['), F.col("inside"), F.lit("]"))), F.lit("}"))
    return members.drop(*ids), cut_lineage(bodies.select(SPACE, "body", "candidates", lists.alias("lists"), *[F.col(c) for c in shown]))


def scope_parts(units: DataFrame, levels: dict[str, DataFrame], chapters: DataFrame | None = None, sections: DataFrame | None = None, views: Sequence[Column] = ()) -> DataFrame:
    """standard_uid, unit_uid, candidates, unit, lists: the two parts of each request of ``scope_requests``, and ``views``: columns that are worked out from a ``piece`` (a JSON list of some candidates, by id) once for all units of one choice; those of the pieces are joined by commas."""
    members, bodies = scope_bodies(units, levels, chapters, sections, views)
    chunks = members.groupBy(SPACE, "body").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("chunks"))
    dealt = members.join(chunks, [SPACE, "body"]).withColumn("chunk", F.pmod(F.hash("unit_uid"), F.col("chunks"))).drop("chunks")
    copies = bodies.join(chunks, [SPACE, "body"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    own = F.to_json(F.struct(report_scope().alias("report_unit")), {"ignoreNullFields": "false"}).alias("unit")
    rows = units.select(SPACE, "unit_uid", own).join(dealt, [SPACE, "unit_uid"])
    return rows.join(copies.hint("merge"), [SPACE, "body", "chunk"]).drop("body", "chunk")


def scope_requests(units: DataFrame, levels: dict[str, DataFrame], chapters: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """standard_uid, unit_uid, candidates, payload: one JSON request a unit for the next step of its comparison with a standard.

    units: standard_uid, unit_uid, title, section_path[], structural_path[], text, page_span[].  levels: ``hierarchy``.
    Without ``chapters`` (standard_uid, unit_uid, chapter_id: those chosen) the step is to choose chapters
    of all that the standard has; without ``sections`` (likewise, section_id) to choose sections within
    the chapters; else to assess the clauses of the sections.  A unit without candidates has no request.

    A request holds one standard's outline or the clauses of its chosen sections at most.  What units
    of one choice share is gathered and written as JSON once; it meets them in chunks of ``SHARE`` units.
    """
    rest = F.expr("concat(left(unit, length(unit) - 1), ',', substring(lists, 2))")
    return scope_parts(units, levels, chapters, sections).select(SPACE, "unit_uid", "candidates", rest.alias("payload"))
