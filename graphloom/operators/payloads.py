"""Drifted model output: containers and field names in many spellings, brought into one shape.

Payloads are parsed to VARIANT once; the first container that is there counts.  What doesn't parse
goes to a quarantine, with its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where items may stand, and the spellings of their fields.
CONTAINERS = ["$.items", "$.results", "$.clauses", "$.extracted_requirements", "$.data.items", "$.data.results", "$.data.clauses"]
TITLE_CONTAINERS = ["$.items", "$.results", "$.titles", "$.classifications", "$.decisions", "$.data.items", "$.data.results", "$.data.titles", "$.data.classifications"]
TITLE_LABELS = ["clause", "section", "reference_standard", "chapter", "appendix", "none"]
#: What a report's title role means: level and whether it is structural; the role is the kind.
REPORT_ROLES = {
    "front_matter": (1, False), "toc": (1, False), "chapter": (1, True), "section": (2, True), "subsection": (3, True),
    "topic": (4, False), "subtopic": (5, False), "appendix": (1, True), "ignore": (4, False),
}
ASSESSMENT_CONTAINERS = ["$.items", "$.assessments", "$.results", "$.clauses", "$.clause_results", "$.evaluations", "$.comparisons", "$.data.items"]
REASON = ["reason", "rationale", "explanation", "analysis"]
EVIDENCE = ["report_evidence", "evidence", "reportEvidence", "quote"]
# End of fixed values.


def parsed(rows: DataFrame, column: str = "payload") -> DataFrame:
    return rows.withColumn("v", F.try_parse_json(F.col(column)))


def quarantined(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Rows whose payload is no JSON."""
    return parsed(rows, column).where("v IS NULL").drop("v")


def first_of(v: Column, paths: list[str], kind: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def listed(v: Column, containers: list[str], single: str) -> Column:
    """The items: the first container, else a bare list, else the object itself if it has the field ``single``."""
    alone = F.when(F.try_variant_get(v, single, "string").isNotNull(), F.array(v))
    return F.coalesce(first_of(v, containers, "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), alone, F.array().cast("array<variant>"))


def named(v: Column, names: list[str], kind: str = "string") -> Column:
    return first_of(v, [f"$.{n}" for n in names], kind)


def strings(v: Column, name: str) -> Column:
    """A field that is a list of strings or one string."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.when(F.try_variant_get(v, f"$.{name}", "string").isNotNull(), F.array(F.try_variant_get(v, f"$.{name}", "string"))), F.array().cast("array<string>"))


def extracted(r: Column) -> Column:
    """One returned requirement with all its fields, as ``requirements.from_items`` takes it."""
    lists = ("action", "object", "judgement_criteria", "evidence_expected", "domain_tags")
    return F.struct(
        named(r, ["requirement_text", "text", "requirement"]).alias("requirement_text"), *[named(r, [c]).alias(c) for c in ("modality", "subject", "applicability_rule", "confidence")],
        *[strings(r, c).alias(c) for c in lists], F.try_variant_get(r, "$.cited_targets", "array<struct<standard_code:string,clause_ref:string,citation_type:string>>").alias("cited_targets"),
    )


def extraction_items(rows: DataFrame, key: str) -> DataFrame:
    """key, clause_uid, concepts, texts and whole requirements of each returned item."""
    each = parsed(rows).where("v IS NOT NULL").select(key, F.explode(listed(F.col("v"), CONTAINERS, "$.clause_uid")).alias("i"))
    found = F.coalesce(named(F.col("i"), ["requirements", "extracted_requirements"], "array<variant>"), F.array().cast("array<variant>"))
    whole = F.filter(F.transform(found, extracted), lambda r: r["requirement_text"].isNotNull())
    out = each.select(key, named(F.col("i"), ["clause_uid", "clause_id", "id"]).alias("clause_uid"), strings(F.col("i"), "concepts").alias("concepts"), whole.alias("requirements"))
    return out.where("clause_uid IS NOT NULL").withColumn("texts", F.col("requirements.requirement_text"))


def number(v: Column, name: str) -> Column:
    """A field that is a number, not a number's text."""
    path = f"$.{name}"
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) != "STRING", F.try_variant_get(v, path, "double"))


def title_items(rows: DataFrame, key: str) -> DataFrame:
    """key, title_id, label, confidence, rationale for each title of a standard that has one of the known labels.

    Without a container, the object itself is one decision if it names a title, else a map from id to a
    label or to a decision; so is a field ``labels``.  A confidence that is no number counts as 0.
    """
    v, i = F.col("v"), F.col("i")
    good = parsed(rows).where("v IS NOT NULL")
    listed_ids = good.select(key, F.explode(listed(v, TITLE_CONTAINERS, "$.title_id")).alias("i")).select(key, named(i, ["title_id", "id", "titleId"]).alias("title_id"), i)
    alone = first_of(v, TITLE_CONTAINERS, "array<variant>").isNull() & F.try_variant_get(v, "$.title_id", "string").isNull()
    whole = F.when(alone, F.try_variant_get(v, "$", "map<string,variant>"))
    none = F.create_map().cast("map<string,variant>")
    mapped = good.select(key, F.explode(F.map_entries(F.coalesce(whole, none))).alias("e")).unionByName(good.select(key, F.explode(F.map_entries(F.coalesce(F.try_variant_get(v, "$.labels", "map<string,variant>"), none))).alias("e")))
    each = listed_ids.unionByName(mapped.select(key, F.col("e.key").alias("title_id"), F.col("e.value").alias("i")))
    text = F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string"))
    label = F.lower(F.trim(F.coalesce(text, named(i, ["label", "type", "role", "classification", "category"]))))
    confidence = F.coalesce(number(i, "confidence"), number(i, "score"), F.lit(0.0))
    out = each.select(key, "title_id", label.alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"), F.trim(F.coalesce(named(i, ["rationale", "reason"]), F.lit(""))).alias("rationale"))
    return out.where((F.col("title_id") != "") & F.col("label").isin(*TITLE_LABELS))


def report_title_items(rows: DataFrame, key: str) -> DataFrame:
    """key, title_id, kind, level, structural, ref, confidence, rationale for each title of a report with a known role.

    The items are the first of ``items`` and ``results`` that isn't empty, or a bare list.  Blank references and
    reasons, and confidences that are no numbers, are null.
    """
    v, i = F.col("v"), F.col("i")
    filled = lambda path: F.when(F.size(F.try_variant_get(v, path, "array<variant>")) > 0, F.try_variant_get(v, path, "array<variant>"))
    each = parsed(rows).where("v IS NOT NULL").select(key, F.explode(F.coalesce(filled("$.items"), filled("$.results"), filled("$"))).alias("i"))
    field = lambda name: F.nullif(F.trim(F.try_variant_get(i, f"$.{name}", "string")), F.lit(""))
    role = F.lower(field("role"))
    known = F.create_map(*[x for name, (level, own) in REPORT_ROLES.items() for x in (F.lit(name), F.struct(F.lit(level).alias("level"), F.lit(own).alias("structural")))])
    out = each.select(key, field("title_id").alias("title_id"), role.alias("kind"), F.try_element_at(known, role).alias("spec"), field("ref").alias("ref"), number(i, "confidence").alias("confidence"), field("rationale").alias("rationale"))
    return out.where("title_id IS NOT NULL AND spec IS NOT NULL").select(key, "title_id", "kind", "spec.level", "spec.structural", "ref", "confidence", "rationale")


def plan_metrics(titles: DataFrame, batches: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Per key: titles asked for, batches, those that came back short, titles planned before the first such batch.

    titles: key, batch, title_id; batches: key, batch, n; answers: key, title_id.  A batch that lacks an
    answer ends the plan: it and those after it stay with the heuristics.
    """
    back = titles.join(answers.select(key, "title_id").distinct(), [key, "title_id"]).groupBy(key, "batch").agg(F.count("*").alias("back"))
    each = batches.join(back, [key, "batch"], "left").withColumn("short", F.coalesce("back", F.lit(0)) < F.col("n"))
    first = each.groupBy(key).agg(F.sum("n").alias("requested"), F.count("*").alias("batches"), F.min(F.when(F.col("short"), F.col("batch"))).alias("ends"))
    planned = each.join(first.select(key, "ends"), key).where(F.col("ends").isNull() | (F.col("batch") < F.col("ends"))).groupBy(key).agg(F.sum("n").alias("planned"))
    return first.join(planned, key, "left").select(key, "requested", "batches", F.col("ends").isNotNull().cast("int").alias("failed_batches"), F.coalesce("planned", F.lit(0)).alias("planned"), "ends")


def assessment_items(rows: DataFrame, key: str) -> DataFrame:
    """key, clause_id, raw_status, reason, evidence for each assessed clause."""
    each = parsed(rows).where("v IS NOT NULL").select(key, F.explode(listed(F.col("v"), ASSESSMENT_CONTAINERS, "$.clause_id")).alias("i"))
    i = F.col("i")
    return each.select(key, named(i, ["clause_id", "clauseId", "id", "clause_ref"]).alias("clause_id"), named(i, ["status", "result", "coverage"]).alias("raw_status"), named(i, REASON).alias("reason"), named(i, EVIDENCE).alias("evidence")).where("clause_id IS NOT NULL")


def attempt_metrics(attempts: DataFrame, key: str) -> DataFrame:
    """Per key: requests, successes, failures, retried ones, attempts in all."""
    by = attempts.groupBy(key, "request").agg(F.max("attempt").alias("attempts"), F.max("ok").alias("ok"))
    return by.groupBy(key).agg(F.count("*").alias("requested"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("attempts") > 1).alias("retried"), F.sum("attempts").alias("attempts"))


def confusion(rows: DataFrame, baseline: str, predicted: str) -> DataFrame:
    """Counts of every (baseline, predicted) pair; a missing side is ``none``."""
    return rows.groupBy(F.coalesce(F.col(baseline), F.lit("none")).alias("baseline"), F.coalesce(F.col(predicted), F.lit("none")).alias("predicted")).agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, baseline: str, predicted: str) -> DataFrame:
    same = F.coalesce(F.col(baseline) == F.col(predicted), F.lit(False))
    return rows.agg(F.count("*").alias("titles"), F.count_if(same).alias("equal"), F.count_if(F.col(baseline).isNull() & F.col(predicted).isNotNull()).alias("upgraded"))


def scored_batches(rows: DataFrame, scorer, schema: str) -> DataFrame:
    """The hook for a model: ``scorer`` maps batches of rows (pandas) to rows of ``schema``."""
    return rows.mapInPandas(scorer, schema)
