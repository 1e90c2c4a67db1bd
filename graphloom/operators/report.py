"""Project reports: page roles, title plan, section outline, text units - per document, natively.

Blocks: document_id, page_idx, block_idx, source_type, text.  Windows are partitioned by document;
the only true fold, the context-dependent title plan, runs over each document's array of titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import normative as N
from graphloom.functions.labels import preview
from graphloom.functions.markup import unescaped
from graphloom.operators.scans import folded, states_before
from graphloom.sources.stage import PACKED, bucketed

DOC = "document_id"
# Heading patterns and words, and the size of a text unit.
DOTTED = r"(?U)^(\d+(?:\.\d+)+)\s*(.*)$"
SINGLE = r"(?U)^(\d+)\s*(\S.*)?$"
ENUMERATED = r"(?U)^(\d+[）\)]|\d+[、.])\s*(.+)$"
CHINESE_ENUMERATED = r"(?U)^([一二三四五六七八九十]+[、.])\s*(.+)$"
APPENDIX = r"(?U)^(附录|附件|附表|附图)\s*([A-Za-z0-9一二三四五六七八九十]+)?\s*(.*)$"
FIGURE_REF = r"(?U)(?:图|照片|附图)\s*([A-Za-z0-9+\-.]+)?"
TABLE_REF = r"(?U)(?i)(?:表\s*)?((?:[A-Z])?\d+(?:\.\d+)*(?:-\d+)*)"
TOC = ["目录", "目 录"]
FRONT = ["内容提要", "内容摘要", "摘要"]
UNIT_CHARS, UNIT_BLOCKS, LEVELS, PREVIEW = 900, 4, 5, 500
TEXTUAL = ["paragraph", "equation"]
MEDIA = {"table": "table", "image": "figure"}
KINDS = ("chapter", "section", "subsection", "appendix", "topic", "subtopic", "front_matter", "toc")
IMPLICIT = "前置内容"
#: What a title's form makes of it, whatever stands before: level, whether it has a reference, whether it is structural.
FORMS = {"toc": (1, False, False), "ignore": (4, False, False), "front_matter": (1, False, False), "appendix": (1, True, True), "subsection": (3, True, True), "section": (2, True, True), "subtopic": (5, True, False), "topic": (4, True, False)}
# End of fixed values.


def by() -> Window:
    """The rows of a document in order."""
    return Window.partitionBy(DOC).orderBy("pos")


def so_far() -> Window:
    return by().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def normalize_lines(c: Column) -> Column:
    """Entities resolved, each line normalized, empty lines dropped, line breaks kept."""
    lines = F.transform(F.split(unescaped(F.coalesce(c, F.lit(""))), "\n"), N.normalize_text)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalized(blocks: DataFrame) -> DataFrame:
    """Non-empty blocks with pos, block_id and text_normalized."""
    blocks = blocks if "item_idx" in blocks.columns else blocks.withColumn("item_idx", F.lit(0))
    rows = blocks.withColumn("text_normalized", normalize_lines(F.col("text"))).where("text_normalized <> ''")
    return rows.withColumns({"pos": F.row_number().over(Window.partitionBy(DOC).orderBy("page_idx", "block_idx", "item_idx")), "block_id": N.block_id(F.col("page_idx"), F.col("block_idx"), F.col("item_idx"), 3)})


def structural(c: Column) -> Column:
    return ~c.isin(*TOC, *FRONT) & (c.rlike(APPENDIX) | c.rlike(DOTTED) | c.rlike(SINGLE))


def page_roles(rows: DataFrame) -> DataFrame:
    """Blocks with page_role: front_matter, toc or body, from the first contents page and the first structural one."""
    is_title, text, document = F.col("source_type") == "title", F.col("text_normalized"), Window.partitionBy(DOC)
    rows = rows.withColumn("toc_page", F.min(F.when(is_title & text.isin(*TOC), F.col("page_idx"))).over(document))
    on_toc = F.coalesce(F.col("page_idx") == F.col("toc_page"), F.lit(False))
    rows = rows.withColumn("first_page", F.min(F.when(is_title & structural(text) & ~on_toc, F.col("page_idx"))).over(document))
    before = F.coalesce(F.col("page_idx") < F.col("first_page"), F.col("first_page").isNull())
    role = F.when((F.col("page_idx") >= F.col("toc_page")) & before, "toc").when(F.col("page_idx") < F.col("first_page"), "front_matter").otherwise("body")
    return rows.withColumn("page_role", role).drop("toc_page", "first_page")


def spec(kind, level, ref, is_structural: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), (ref if ref is not None else F.lit(None)).cast("string").alias("ref"), F.lit(is_structural).alias("structural"))


def title_features(rows: DataFrame) -> DataFrame:
    """Titles with all that the plan asks of their texts, each expression evaluated once a title.

    form: what the text alone says (toc, front_matter, appendix, subsection, section, subtopic, topic),
    ``single`` for a bare number that isn't a year, null for none of these; ref: its reference; number:
    of a ``single``; supported: whether the next title continues that number.
    """
    text, titles = F.col("text_normalized"), rows.where("source_type = 'title'")
    following = F.lead("text_normalized").over(by())
    dotted, number = F.regexp_extract(text, DOTTED, 1), F.regexp_extract(text, SINGLE, 1).try_cast("long")
    appendix = F.coalesce(N.blank_to_null(F.regexp_extract(text, APPENDIX, 2)), F.regexp_extract(text, APPENDIX, 1))
    on_toc = F.col("page_role") == "toc"
    forms = [
        (text.isin(*TOC), "toc", None), (on_toc, "ignore", None), (text.isin(*FRONT), "front_matter", None), (text.rlike(APPENDIX), "appendix", appendix), (text.rlike(DOTTED) & (F.size(F.split(dotted, r"\.")) >= 3), "subsection", dotted), (text.rlike(DOTTED), "section", dotted),
        (text.rlike(ENUMERATED), "subtopic", F.regexp_extract(text, ENUMERATED, 1)), (text.rlike(CHINESE_ENUMERATED), "topic", F.regexp_extract(text, CHINESE_ENUMERATED, 1)), (text.rlike(SINGLE) & ~text.startswith("20") & number.isNotNull(), "single", number.cast("string")),
    ]
    found = F.lit(None).cast("struct<form:string,ref:string>")
    for test, form, ref in reversed(forms):
        found = F.when(test, F.struct(F.lit(form).alias("form"), (ref if ref is not None else F.lit(None)).cast("string").alias("ref"))).otherwise(found)
    supported = F.coalesce(following.startswith(F.concat(number.cast("string"), F.lit("."))), F.lit(False))
    return titles.select(DOC, "pos", found.alias("found"), number.alias("number"), supported.alias("supported")).select(DOC, "pos", "found.form", "found.ref", "number", "supported")


def title_plan(rows: DataFrame) -> DataFrame:
    """The heuristic plan: kind, level, reference and whether structural, for every title in order.

    State of the fold: whether anything structural came, the chapter's number, which of the levels
    1..3 on the stack are structural, and the references of the topics on levels 4 and 5.
    """
    titles = title_features(rows).groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("pos", "form", "ref", "number", "supported"))).alias("titles"))
    start = F.struct(F.lit(False).alias("seen"), F.lit(None).cast("long").alias("chapter"), F.array(*[F.lit(False)] * 3).alias("on"), F.lit(None).cast("string").alias("t4"), F.lit(None).cast("string").alias("t5"))

    def decide(s: Column, t: Column) -> Column:
        depth = F.when(s["on"][2], 3).when(s["on"][1], 2).when(s["on"][0], 1).otherwise(0)
        topic = F.coalesce(s["t5"], s["t4"]).try_cast("long")
        as_topic = (depth > 1) & ~t["supported"] & F.coalesce(t["number"] <= topic + 1, F.lit(True))
        as_chapter = s["chapter"].isNull() | ~s["seen"] | (t["number"] == s["chapter"] + 1) | t["supported"]
        single = t["form"] == "single"
        plain = F.coalesce(*[F.when(t["form"] == form, spec(form, level, t["ref"] if has_ref else None, is_structural)) for form, (level, has_ref, is_structural) in FORMS.items()])
        return (
            F.when(single & (as_topic | ~as_chapter), spec("topic", 4, t["ref"], False))
            .when(single, spec("chapter", 1, t["ref"], True))
            .when(t["form"].isNotNull(), plain)
            .when(s["seen"], spec("topic", 4, None, False))
            .otherwise(spec("front_matter", 1, None, False))
        )

    def step(s: Column, t: Column) -> Column:
        def apply(d: Column) -> Column:
            keep, level = d["kind"] != "ignore", d["level"]
            on = F.array(*[F.when(keep & (level < n), F.lit(False)).when(keep & (level == n), d["structural"]).otherwise(s["on"][n - 1]) for n in (1, 2, 3)])
            state = F.struct(
                (s["seen"] | (keep & d["structural"])).alias("seen"), F.when(keep & (d["kind"] == "chapter"), d["ref"].try_cast("long")).otherwise(s["chapter"]).alias("chapter"), on.alias("on"),
                F.when(~keep, s["t4"]).when(level == 4, d["ref"]).when(level < 4, F.lit(None).cast("string")).otherwise(s["t4"]).alias("t4"),
                F.when(~keep, s["t5"]).when(level == 5, d["ref"]).otherwise(F.lit(None).cast("string")).alias("t5"),
            )
            out = F.struct(t["pos"].alias("pos"), d["kind"].alias("kind"), d["level"].alias("level"), d["ref"].alias("ref"), d["structural"].alias("structural"))
            return F.struct(state.alias("state"), out.alias("out"))

        return F.transform(F.array(decide(s, t)), apply)[0]  # binds the decision once

    specs = folded(F.col("titles"), start, step, "struct<pos:int,kind:string,level:int,ref:string,structural:boolean>")
    return titles.select(DOC, F.explode(specs).alias("p")).select(DOC, "p.*", F.lit("heuristic").alias("planner_source"))


def override_plan(plan: DataFrame, decided: DataFrame) -> DataFrame:
    """Decided entries (document_id, pos, kind, level, ref, structural) win; their missing references fall back."""
    named = decided.select(DOC, "pos", *[F.col(c).alias(f"d_{c}") for c in ("kind", "level", "ref", "structural")])
    joined = plan.join(named, [DOC, "pos"], "left")
    has = F.col("d_kind").isNotNull()
    return joined.select(
        DOC, "pos", F.coalesce("d_kind", "kind").alias("kind"), F.coalesce("d_level", "level").alias("level"), F.coalesce("d_ref", "ref").alias("ref"), F.coalesce("d_structural", "structural").alias("structural"),
        F.when(has, "model").otherwise("heuristic").alias("planner_source"),
    )


def plan_source(plan: DataFrame) -> DataFrame:
    """Per document: heuristic, model or hybrid, by where its entries came from."""
    model, every = F.count_if(F.col("planner_source") == "model"), F.count("*")
    return plan.groupBy(DOC).agg(F.when(model == 0, "heuristic").when(model == every, "model").otherwise("hybrid").alias("source"))


def with_stack(rows: DataFrame) -> DataFrame:
    """Rows (pos, level or null, title) with ``stack``: the open sections at the row, outermost first.

    A level is open if its last section came after the last one of every lower level; that is the
    nearest-previous-smaller rule without a stack.
    """
    for n in range(1, LEVELS + 1):
        own = F.when(F.col("level") == n, F.struct("pos", "level", "title", "structural"))
        rows = rows.withColumn(f"l{n}", F.last(own, ignorenulls=True).over(so_far()))
    open_ = []
    for n in range(1, LEVELS + 1):
        lower = [F.coalesce(F.col(f"l{m}.pos"), F.lit(0)) for m in range(1, n)]
        alive = F.col(f"l{n}.pos") > (F.greatest(*lower) if len(lower) > 1 else lower[0]) if lower else F.lit(True)
        open_.append(F.when(F.col(f"l{n}").isNotNull() & alive, F.col(f"l{n}")))
    return rows.withColumn("stack", F.filter(F.array(*open_), lambda x: x.isNotNull())).drop(*[f"l{n}" for n in range(1, LEVELS + 1)])


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Blocks with the plan of their titles (ignored and toc-page titles open nothing) and the open sections.

    Content before any section opens one of its own, on the first level, at its first block.
    """
    own = ("kind", "level", "ref", "structural")
    named = plan.where("kind <> 'ignore'").select(DOC, "pos", F.struct(*own).alias("planned"))
    # texts are dealt by document once, for the plan and for the windows that follow
    both = rows.withColumn("given", F.lit(True)).unionByName(named, allowMissingColumns=True).repartition(DOC)
    at = both.withColumn("planned", F.max("planned").over(Window.partitionBy(DOC, "pos"))).where("given")
    rows = at.select(*rows.columns, *[F.col(f"planned.{c}") for c in own]).withColumn("title", F.when(F.col("level").isNotNull(), F.col("text_normalized")))
    content = (F.col("source_type") != "title") & (F.col("page_role") != "toc")
    before = F.count("level").over(so_far()) + F.count_if(content).over(so_far())
    rows = rows.withColumn("implicit", content & F.col("level").isNull() & (before == 1))
    made = {"title": IMPLICIT, "kind": "front_matter", "level": 1, "structural": False}
    return with_stack(rows.withColumns({c: F.when(F.col("implicit"), F.lit(v)).otherwise(F.col(c)) for c, v in made.items()}))


def sections(stacked: DataFrame) -> DataFrame:
    """One row a section: number in order, parent, path, structural path."""
    rows = stacked.where("level IS NOT NULL")
    nth = F.row_number().over(by())
    path = F.transform("stack", lambda s: s["title"])
    out = rows.select(DOC, "pos", nth.alias("nth"), "title", "kind", "level", "ref", "structural", F.when(F.col("implicit"), 1).otherwise(F.col("page_idx")).alias("page_idx"), F.when(F.col("implicit"), "front_matter").otherwise(F.col("page_role")).alias("page_role"), F.when(F.col("implicit"), "auto-front-matter").otherwise(F.col("block_id")).alias("block_id"), "implicit", path.alias("path"), F.transform(F.filter("stack", lambda s: s["structural"]), lambda s: s["title"]).alias("structural_path"), F.when(F.size("stack") > 1, F.element_at("stack", -2)["pos"]).alias("parent_pos"))
    return out.withColumn("section_uid", F.concat(F.lit("report:"), F.col(DOC), F.lit(":section:"), F.col("nth").cast("string")))


def text_units(stacked: DataFrame) -> DataFrame:
    """Text units, numbered in order, with their uids and paths."""
    return numbered_units(cut_units(stacked))


def cut_units(stacked: DataFrame) -> DataFrame:
    """Text units: runs of paragraphs cut greedily at 900 characters or 4 blocks; a list item is its own unit.

    Titles, list items, tables and images end a run; blocks of contents pages are skipped and end none.
    """
    textual = F.col("source_type").isin(*TEXTUAL)
    rows = stacked.where((F.col("source_type") == "title") | (F.col("page_role") != "toc"))
    rows = rows.withColumn("run", F.sum((~textual).cast("int")).over(so_far()))
    own = F.struct("pos", "text_normalized", "page_idx", "block_id", "stack", "page_role")
    in_run = Window.partitionBy(DOC, "run").orderBy("pos")
    # how many blocks a unit takes that begins here: it depends on the next few alone
    sums, taken = F.length("text_normalized"), F.lit(UNIT_BLOCKS)
    for n in range(UNIT_BLOCKS - 1, 0, -1):
        upto = sum((F.coalesce(F.lead(F.length("text_normalized"), k).over(in_run), F.lit(0)) for k in range(1, n)), sums)
        taken = F.when(upto >= UNIT_CHARS, n).otherwise(taken)
    blocks = rows.where(textual).select(DOC, "run", own.alias("own"), (F.row_number().over(in_run) - 1).alias("at"), taken.alias("taken"))
    # state: blocks that the open unit still takes
    step = F.array(F.col("taken") - 1, *[F.lit(n - 1) for n in range(1, UNIT_BLOCKS)])
    # by document, texts move once for all that follows
    states = states_before(bucketed(blocks.select(DOC, "run", "own", "at", step.alias("step")), [DOC], "runs", dealt=True, **PACKED), [DOC, "run"], "at", "step", ["own"], UNIT_BLOCKS)
    begun = F.sum((F.col("state") == 0).cast("int")).over(Window.partitionBy(DOC, "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    units = states.select(DOC, "run", begun.alias("chunk"), "own.*").groupBy(DOC, "run", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text_normalized"))), lambda x: x["text_normalized"]), "\n").alias("text"), F.count("*").alias("blocks"), F.min("page_idx").alias("first_page"), F.max("page_idx").alias("last_page"),
        F.max("pos").alias("pos"), F.max_by("page_idx", "pos").alias("unit_page"), F.max_by("block_id", "pos").alias("last_block"), F.min_by("stack", "pos").alias("stack"), F.min_by("page_role", "pos").alias("page_role"),
    ).drop("run", "chunk").withColumn("unit_type", F.lit("text"))
    page = F.col("page_idx")
    items = rows.where("source_type = 'list_item'").select(
        DOC, F.col("text_normalized").alias("text"), F.lit(1).cast("long").alias("blocks"), page.alias("first_page"), page.alias("last_page"), "pos", page.alias("unit_page"), F.col("block_id").alias("last_block"), "stack", "page_role", F.lit("list_item").alias("unit_type")
    )
    return units.unionByName(items)


def numbered_units(units: DataFrame) -> DataFrame:
    units = units.withColumn("nth", F.row_number().over(by())).withColumn("unit_uid", F.concat(F.lit("report:"), F.col(DOC), F.lit(":unit:"), F.col("nth").cast("string")))
    return units.withColumns({"parent_pos": F.try_element_at("stack", F.lit(-1))["pos"], "section_path": F.transform("stack", lambda s: s["title"]), "structural_path": F.transform(F.filter("stack", lambda s: s["structural"]), lambda s: s["title"])})


def media(stacked: DataFrame) -> DataFrame:
    """Tables and figures, one row each, numbered apart within their document; those of contents pages are skipped.

    caption, footnote, html, item_ref and image_path are taken where the blocks have them.
    """
    rows = stacked.where(F.col("source_type").isin(*MEDIA) & (F.col("page_role") != "toc")).withColumn("part", F.when(F.col("source_type") == "table", MEDIA["table"]).otherwise(MEDIA["image"]))
    given = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("caption", "footnote", "html", "item_ref", "image_path")]
    nth = F.row_number().over(Window.partitionBy(DOC, "part").orderBy("pos"))
    named = rows.select(
        DOC, "pos", "part", nth.alias("nth"), "page_idx", "page_role", "block_id", F.col("text_normalized").alias("text"), *given, "stack", F.try_element_at("stack", F.lit(-1))["pos"].alias("parent_pos"),
        F.transform("stack", lambda s: s["title"]).alias("section_path"), F.transform(F.filter("stack", lambda s: s["structural"]), lambda s: s["title"]).alias("structural_path"),
    )
    return named.withColumn("uid", F.concat(F.lit("report:"), F.col(DOC), F.lit(":"), F.col("part"), F.lit(":"), F.col("nth").cast("string")))


def implicit_sections(found: DataFrame, units: DataFrame) -> DataFrame:
    """The sections that content before any title opened, with the number of their own units."""
    own = units.groupBy(DOC, F.col("parent_pos").alias("pos")).agg(F.count("*").alias("units"))
    return found.where("implicit").join(own, [DOC, "pos"], "left").select(DOC, "pos", "section_uid", "title", "page_idx", F.coalesce("units", F.lit(0)).alias("units"))


def contents(units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Units, and tables and figures if given, under one set of names."""
    own = units.select(DOC, "pos", F.col("unit_uid").alias("uid"), F.lit("unit").alias("part"), "parent_pos", "text", F.col("unit_page").alias("page"), F.col("last_block").alias("block"), "stack")
    if others is None:
        return own
    return own.unionByName(others.select(DOC, "pos", "uid", "part", "parent_pos", "text", F.col("page_idx").alias("page"), F.col("block_id").alias("block"), "stack"))


def section_contents(found: DataFrame, units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Sections with what their whole subtree holds: number and uids, page span and outermost blocks (of units' last blocks), preview."""
    shown = F.substring("text", 1, PREVIEW).alias("text")  # no more of one text is in a preview
    member = contents(units, others).withColumnRenamed("pos", "at").select(DOC, "at", "uid", "page", "block", shown, F.explode(F.transform("stack", lambda s: s["pos"])).alias("pos"))
    inside = F.array_sort(F.collect_list(F.struct("at", "text", "uid")))
    grouped = member.groupBy(DOC, "pos").agg(
        F.count("*").alias("members"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min_by("block", "at").alias("first_block"), F.max_by("block", "at").alias("last_block"),
        F.substring(F.array_join(F.transform(inside, lambda x: x["text"]), "\n"), 1, PREVIEW).alias("content_preview"), F.transform(inside, lambda x: x["uid"]).alias("member_uids"),
    )
    own = found.join(grouped, [DOC, "pos"], "left")
    return own.withColumns({"members": F.coalesce("members", F.lit(0)), "first_page": F.coalesce("first_page", "page_idx"), "last_page": F.coalesce("last_page", "page_idx"), "content_preview": F.coalesce("content_preview", F.lit("")), "member_uids": F.coalesce("member_uids", F.array().cast("array<string>"))})


def all_parts(found: DataFrame, units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Sections and their contents; ``first`` orders a section before the block that opened it."""
    heads = found.select(DOC, "pos", F.col("section_uid").alias("uid"), F.lit("section").alias("part"), "parent_pos")
    return heads.unionByName(contents(units, others).select(*heads.columns)).withColumn("first", F.when(F.col("part") == "section", 0).otherwise(1))


def ordered_parts(found: DataFrame, units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Sections, units, tables and figures numbered together in the order in which they end."""
    return all_parts(found, units, others).withColumn("order_index", F.row_number().over(Window.partitionBy(DOC).orderBy("pos", "first")))


def space_view(found: DataFrame, units: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, units) as a report space shows them: parents by uid, place among all parts, page span, members."""
    up = found.select(DOC, F.col("pos").alias("parent_pos"), F.col("section_uid").alias("parent_section_uid"))
    order = ordered_parts(found, units, others).select(DOC, "uid", "order_index")
    # places are found without the texts, which move once
    place = lambda rows, uid: rows.join(rows.select(DOC, uid, "parent_pos").join(up, [DOC, "parent_pos"], "left").drop("parent_pos").join(order.withColumnRenamed("uid", uid), [DOC, uid]), [DOC, uid])
    pages = [F.array(F.col("first_page"), F.col("last_page")).alias("page_span")]
    heads = place(section_contents(found, units, others), "section_uid").select(DOC, "section_uid", "parent_section_uid", "title", F.col("kind").alias("section_kind"), "path", "order_index", *pages, F.col("members").alias("member_count"))
    own = place(units, "unit_uid").select(DOC, "unit_uid", "parent_section_uid", "unit_type", "section_path", "structural_path", "text", "order_index", *pages)
    return heads, own


def scopes(units: DataFrame, found: DataFrame) -> DataFrame:
    """Text units gathered by their section (units without one stand alone)."""
    text = units.where("unit_type = 'text'").join(found.select(DOC, F.col("pos").alias("parent_pos"), F.col("section_uid").alias("parent_uid"), "title"), [DOC, "parent_pos"], "left")
    scope = F.coalesce("parent_uid", "unit_uid")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return text.groupBy(DOC, scope.alias("scope_uid")).agg(F.max("title").alias("title"), F.array_join(texts, "\n\n").alias("text"), F.count("*").alias("units"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))


def report_metrics(rows: DataFrame, found: DataFrame, units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Per document: pages by role, sections by kind, units, tables and figures."""
    pages = rows.groupBy(DOC).agg(*[F.count_distinct(F.when(F.col("page_role") == r, F.col("page_idx"))).alias(f"{r}_pages") for r in ("front_matter", "toc", "body")])
    kinds = found.groupBy(DOC).agg(F.count("*").alias("sections"), *[F.count_if(F.col("kind") == k).alias(f"{k}_sections") for k in KINDS])
    whole = pages.join(kinds, DOC, "left").join(units.groupBy(DOC).agg(F.count("*").alias("units"), F.count_if(F.col("page_role") == "front_matter").alias("front_matter_units")), DOC, "left")
    if others is not None:
        whole = whole.join(others.groupBy(DOC).agg(*[F.count_if(F.col("part") == m).alias(f"{m}s") for m in MEDIA.values()]), DOC, "left")
    return whole.fillna(0)


def text_previews(rows: DataFrame, most: int = 180) -> DataFrame:
    """For every title: the nearest text before it, and the texts after it up to the next title, to ``most`` characters."""
    textual = (F.col("source_type") != "title") & (F.col("page_role") != "toc")
    text = F.when(textual, preview(F.col("text_normalized"), most))
    before = F.last(text, ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"shown": text, "before": before, "group": F.sum((F.col("source_type") == "title").cast("int")).over(so_far())})
    within = Window.partitionBy(DOC, "group").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # a text is taken while those before it, joined by blanks, are still short of ``most``
    shown_before = F.coalesce(F.sum(F.length("shown") + 1).over(within), F.lit(0)) - 1
    taken = rows.withColumn("taken", F.when(shown_before < most, F.col("shown")))
    after = taken.groupBy(DOC, "group").agg(preview(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("taken").isNotNull(), F.struct("pos", "taken")))), lambda x: x["taken"]), "\n"), most).alias("after"))
    return rows.where("source_type = 'title'").join(after, [DOC, "group"]).select(DOC, "pos", "before", N.blank_to_null(F.col("after")).alias("after"))


def numbering_pattern(c: Column) -> Column:
    """What numbers a title: toc, appendix, dotted, enumerated, chinese_enumerated, single_number (no year) or plain."""
    forms = {"appendix": APPENDIX, "dotted": DOTTED, "enumerated": ENUMERATED, "chinese_enumerated": CHINESE_ENUMERATED}
    numbered = F.coalesce(*[F.when(c.rlike(pattern), name) for name, pattern in forms.items()], F.when(c.rlike(SINGLE) & ~c.startswith("20"), "single_number"), F.lit("plain"))
    return F.when(c.isin(*TOC), "toc").otherwise(numbered)


def title_inventory(rows: DataFrame) -> DataFrame:
    """Titles in order: their neighbors among the titles, the texts around them, how they are numbered, whether they look structural."""
    level = F.col("raw_title_level") if "raw_title_level" in rows.columns else F.lit(None).cast("int")
    text = F.col("text_normalized")
    titles = rows.where("source_type = 'title'").select(
        DOC, "pos", F.col("block_id").alias("title_id"), F.row_number().over(by()).alias("title_index"), "page_idx", "page_role", "text", "text_normalized", level.alias("raw_title_level"),
        F.lag(text).over(by()).alias("previous_title"), F.lead(text).over(by()).alias("next_title"), numbering_pattern(text).alias("numbering_pattern"), structural(text).alias("looks_structural"),
    )
    around = text_previews(rows).withColumnsRenamed({"before": "preceding_text_preview", "after": "following_text_preview"})
    return titles.join(around, [DOC, "pos"], "left")


def report_nodes(found: DataFrame, units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Nodes of a report's graph: the report, its sections (with a preview of what they hold), units, tables and figures."""
    return outline_nodes(found, units, others).unionByName(content_nodes(units, others))


def joined_text(*cs) -> Column:
    return F.array_join(F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != "")), "\n")


def outline_nodes(found: DataFrame, units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The report and its sections."""
    root = all_parts(found, units, others).select(DOC).distinct().select(DOC, F.concat(F.lit("report:"), DOC).alias("node_uid"), F.lit("report").alias("node_type"), F.col(DOC).alias("label"), F.col(DOC).alias("text_content"))
    heads = section_contents(found, units, others).select(DOC, F.col("section_uid").alias("node_uid"), F.lit("report_section").alias("node_type"), F.col("title").alias("label"), joined_text(F.array_join("structural_path", " > "), F.col("title"), F.col("content_preview")).alias("text_content"))
    return root.unionByName(heads)


def content_nodes(units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Units, tables and figures, one by one from their rows."""
    nodes = units.select(DOC, F.col("unit_uid").alias("node_uid"), F.lit("report_unit").alias("node_type"), F.substring("text", 1, 80).alias("label"), F.col("text").alias("text_content"))
    if others is None:
        return nodes
    footnote = F.when(F.col("part") == "figure", F.col("footnote"))
    shown = others.select(DOC, F.col("uid").alias("node_uid"), F.concat(F.lit("report_"), F.col("part")).alias("node_type"), F.coalesce("caption", "item_ref", "uid").alias("label"), joined_text(F.col("caption"), footnote, F.col("text")).alias("text_content"))
    return nodes.unionByName(shown.withColumn("text_content", F.coalesce(N.blank_to_null(F.col("text_content")), "node_uid")))


def report_edges(found: DataFrame, units: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """CONTAINS from parents (the report where there is none) and NEXT between siblings in order."""
    up = found.select(DOC, F.col("pos").alias("parent_pos"), F.col("section_uid").alias("parent_uid"))
    placed = all_parts(found, units, others).join(up, [DOC, "parent_pos"], "left").withColumn("parent_uid", F.coalesce("parent_uid", F.concat(F.lit("report:"), DOC)))
    contains = placed.select(DOC, F.lit("CONTAINS").alias("edge_type"), F.col("parent_uid").alias("source_uid"), F.col("uid").alias("target_uid"))
    siblings = Window.partitionBy(DOC, "parent_uid").orderBy("pos", "first")
    follow = placed.withColumn("following", F.lead("uid").over(siblings)).where("following IS NOT NULL").select(DOC, F.lit("NEXT").alias("edge_type"), F.col("uid").alias("source_uid"), F.col("following").alias("target_uid"))
    both = contains.unionByName(follow)
    return both.withColumn("edge_uid", N.edge_uid(F.col("edge_type"), F.col("source_uid"), F.col("target_uid")))
