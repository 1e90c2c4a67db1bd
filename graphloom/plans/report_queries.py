"""Registered queries over project reports (binding ``doc_blocks``), each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import report
from graphloom.sources.bindings import DOC_BLOCKS, DUCK_LINES, doc_blocks, duck
from graphloom.sources.stage import cut_lineage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: The documents' titles as headings of every form; some begin with contents or a summary, some with text that no heading precedes.
HEADED_BLOCKS = """SELECT document_id, page_idx, block_idx, CASE WHEN block_idx = 1 AND length(text) % 4 = 0 THEN 'paragraph' ELSE source_type END AS source_type, CASE
 WHEN source_type <> 'title' OR block_idx = 1 AND length(text) % 4 = 0 THEN text
 WHEN block_idx = 1 AND length(text) % 4 = 1 THEN '目录' WHEN block_idx = 1 AND length(text) % 4 = 2 THEN '内容摘要'
 WHEN form = 0 THEN concat(CAST(chapter AS VARCHAR(9)), ' ', text) WHEN form = 1 THEN concat(CAST(chapter AS VARCHAR(9)), '.', CAST(part AS VARCHAR(9)), ' ', text)
 WHEN form = 2 THEN concat(CAST(chapter AS VARCHAR(9)), '.', CAST(part AS VARCHAR(9)), '.2 ', text) WHEN form = 3 THEN concat(CAST(part AS VARCHAR(9)), '）', text)
 WHEN form = 4 THEN concat('二、', text) WHEN form = 5 THEN concat('附录B ', text) WHEN form = 6 THEN concat(CAST(part AS VARCHAR(9)), ' ', text)
 WHEN form = 7 THEN concat('20', CAST(part AS VARCHAR(9)), ' ', text) WHEN form = 8 THEN '附图' WHEN form = 9 THEN CAST(chapter + 1 AS VARCHAR(9)) ELSE text END AS text
FROM (SELECT *, (block_idx * 7 + length(text)) % 13 AS form, CAST(floor(block_idx / 12) AS INT) + 1 AS chapter, block_idx % 4 + 1 AS part FROM plain_blocks) t"""
B = """SELECT document_id, page_idx, block_idx, source_type, t AS text, row_number() OVER (PARTITION BY document_id ORDER BY page_idx, block_idx) AS pos FROM
 (SELECT *, trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')) AS t FROM doc_blocks) WHERE t <> ''"""
# The real title plan in SQL: page roles, what each title's text says, then the reading of titles in order.
APP, DOT, ONE = r"^(附录|附件|附表|附图)\s*([A-Za-z0-9一二三四五六七八九十]+)?\s*(.*)$", r"^(\d+(?:\.\d+)+)\s*(.*)$", r"^(\d+)\s*(\S.*)?$"
TOC_, FRONT_ = "('目录', '目 录')", "('内容提要', '内容摘要', '摘要')"
PAGES = f"""SELECT document_id, toc_page, min(CASE WHEN source_type = 'title' AND text NOT IN {TOC_} AND text NOT IN {FRONT_} AND (regexp_matches(text, '{APP}') OR regexp_matches(text, '{DOT}') OR regexp_matches(text, '{ONE}')) AND NOT coalesce(page_idx = toc_page, false) THEN page_idx END) AS first_page
 FROM b JOIN (SELECT document_id, min(CASE WHEN source_type = 'title' AND text IN {TOC_} THEN page_idx END) AS toc_page FROM b GROUP BY ALL) USING (document_id) GROUP BY ALL"""
PR = "SELECT b.*, CASE WHEN page_idx >= toc_page AND coalesce(page_idx < first_page, first_page IS NULL) THEN 'toc' WHEN page_idx < first_page THEN 'front_matter' ELSE 'body' END AS page_role FROM b JOIN pages USING (document_id)"
TF = rf"""SELECT *, CASE form WHEN 'appendix' THEN coalesce(nullif(regexp_extract(text, '{APP}', 2), ''), regexp_extract(text, '{APP}', 1)) WHEN 'subsection' THEN dotted WHEN 'section' THEN dotted
  WHEN 'subtopic' THEN regexp_extract(text, '^(\d+[）\)]|\d+[、.])\s*(.+)$', 1) WHEN 'topic' THEN regexp_extract(text, '^([一二三四五六七八九十]+[、.])\s*(.+)$', 1) WHEN 'single' THEN CAST(number AS VARCHAR) END AS ref,
  coalesce(starts_with(following, number || '.'), false) AS supported FROM (
 SELECT *, CASE WHEN text IN {TOC_} THEN 'toc' WHEN page_role = 'toc' THEN 'ignore' WHEN text IN {FRONT_} THEN 'front_matter' WHEN regexp_matches(text, '{APP}') THEN 'appendix' WHEN len(string_split(dotted, '.')) >= 3 THEN 'subsection' WHEN dotted <> '' THEN 'section'
  WHEN regexp_matches(text, '^(\d+[）\)]|\d+[、.])\s*(.+)$') THEN 'subtopic' WHEN regexp_matches(text, '^([一二三四五六七八九十]+[、.])\s*(.+)$') THEN 'topic' WHEN number IS NOT NULL AND NOT starts_with(text, '20') THEN 'single' END AS form FROM (
 SELECT document_id, pos, text, page_role, regexp_extract(text, '{DOT}', 1) AS dotted, TRY_CAST(regexp_extract(text, '{ONE}', 1) AS BIGINT) AS number, lead(text) OVER w AS following, row_number() OVER w AS i FROM pr WHERE source_type = 'title' WINDOW w AS (PARTITION BY document_id ORDER BY pos)))"""
DEPTH = "CASE WHEN on3 THEN 3 WHEN on2 THEN 2 WHEN on1 THEN 1 ELSE 0 END"
DECIDED = f"""SELECT s.*, f.document_id AS d, f.pos AS p, f.i AS j, f.ref AS r, CASE WHEN form = 'single' AND (({DEPTH} > 1 AND NOT supported AND coalesce(number <= TRY_CAST(coalesce(t5, t4) AS BIGINT) + 1, true)) OR NOT (chapter IS NULL OR NOT seen OR number = chapter + 1 OR supported)) THEN 'topic'
  WHEN form = 'single' THEN 'chapter' WHEN form IS NOT NULL THEN form WHEN seen THEN 'topic' ELSE 'front_matter' END AS k FROM tp s JOIN tf f ON f.document_id = s.document_id AND f.i = s.i + 1"""
TP = f"""SELECT document_id, CAST(NULL AS INTEGER) AS pos, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS level, CAST(NULL AS VARCHAR) AS ref, false AS structural, false AS seen, CAST(NULL AS BIGINT) AS chapter, false AS on1, false AS on2, false AS on3, CAST(NULL AS VARCHAR) AS t4, CAST(NULL AS VARCHAR) AS t5 FROM tf WHERE i = 1
 UNION ALL SELECT d, CAST(p AS INTEGER), j, k, n, r, st, seen OR (keep AND st), CASE WHEN k = 'chapter' THEN TRY_CAST(r AS BIGINT) ELSE chapter END, {', '.join(f"CASE WHEN keep AND n < {m} THEN false WHEN keep AND n = {m} THEN st ELSE on{m} END" for m in (1, 2, 3))},
  CASE WHEN NOT keep THEN t4 WHEN n = 4 THEN r WHEN n < 4 THEN NULL ELSE t4 END, CASE WHEN NOT keep THEN t5 WHEN n = 5 THEN r END
 FROM (SELECT *, k <> 'ignore' AS keep, k IN ('chapter', 'section', 'subsection', 'appendix') AS st, CASE k WHEN 'section' THEN 2 WHEN 'subsection' THEN 3 WHEN 'topic' THEN 4 WHEN 'ignore' THEN 4 WHEN 'subtopic' THEN 5 ELSE 1 END AS n FROM ({DECIDED}))"""
L = """SELECT * REPLACE (CASE WHEN implicit THEN 1 ELSE level END AS level, CASE WHEN implicit THEN 'front_matter' ELSE kind END AS kind, CASE WHEN implicit THEN false ELSE structural END AS structural) FROM (
 SELECT *, content AND level IS NULL AND count(level) OVER w + count(*) FILTER (content) OVER w = 1 AS implicit FROM (
 SELECT pr.*, kind, level, ref, structural, source_type <> 'title' AND page_role <> 'toc' AS content FROM pr LEFT JOIN (SELECT * FROM tp WHERE kind <> 'ignore') t USING (document_id, pos)) WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""
LAST = ", ".join(f"max(CASE WHEN level = {n} THEN pos END) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS l{n}" for n in range(1, 6))
S = f"SELECT *, {LAST} FROM l"
ALIVE = "[" + ", ".join(f"CASE WHEN l{n} > greatest(0{''.join(f', coalesce(l{m}, 0)' for m in range(1, n))}) THEN l{n} END" for n in range(1, 6)) + "]"
K = f"SELECT *, list_filter({ALIVE}, lambda x: x IS NOT NULL) AS stack FROM s"
#: Greedy units: the runs of paragraphs, cut by a fold.
R = "SELECT *, sum(CASE WHEN source_type <> 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM k WHERE source_type = 'title' OR page_role <> 'toc'"
P = "SELECT *, row_number() OVER (PARTITION BY document_id, run ORDER BY pos) AS nth, length(text) AS n FROM r WHERE source_type = 'paragraph'"
F_ = """SELECT document_id, run, nth, n AS chars, 1 AS cnt, 0 AS chunk, n >= 900 AS was_full FROM p WHERE nth = 1 UNION ALL
 SELECT p.document_id, p.run, p.nth, CASE WHEN f.was_full THEN p.n ELSE f.chars + p.n END, CASE WHEN f.was_full THEN 1 ELSE f.cnt + 1 END, f.chunk + CASE WHEN f.was_full THEN 1 ELSE 0 END,
 CASE WHEN f.was_full THEN p.n >= 900 ELSE f.chars + p.n >= 900 OR f.cnt + 1 >= 4 END FROM f JOIN p ON p.document_id = f.document_id AND p.run = f.run AND p.nth = f.nth + 1"""
U = """SELECT document_id, pos, text, blocks, first_page, last_page, parent_pos, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS nth, unit_page, stack, page_role FROM (
 SELECT p.document_id, max(pos) AS pos, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) AS blocks, min(page_idx) AS first_page, max(page_idx) AS last_page, any_value(stack[-1]) AS parent_pos, arg_max(page_idx, pos) AS unit_page, any_value(stack) AS stack, arg_min(page_role, pos) AS page_role FROM p JOIN f USING (document_id, run, nth) GROUP BY p.document_id, p.run, chunk
 UNION ALL SELECT document_id, pos, text, 1, page_idx, page_idx, stack[-1], page_idx, stack, page_role FROM r WHERE source_type = 'list_item')"""
#: Reports with tables (lines with cells) and figures (some paragraphs), every second one without a first title: its first content opens a section.
MEDIA_BLOCKS = """SELECT document_id, page_idx, block_idx, CASE WHEN text LIKE '%|%' THEN 'table' WHEN source_type = 'paragraph' AND block_idx % 13 = 0 THEN 'image'
 WHEN block_idx = 1 AND length(text) % 2 = 0 THEN 'paragraph' ELSE source_type END AS source_type, text FROM headed_blocks"""
X = """SELECT document_id, pos, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS nth, stack, page_idx, source_type, CASE WHEN source_type = 'title' THEN text ELSE '前置内容' END AS title, kind, structural, stack[-2] AS parent_pos FROM k WHERE level IS NOT NULL"""
M = """SELECT document_id, pos, CASE source_type WHEN 'table' THEN 'table' ELSE 'figure' END AS part, row_number() OVER (PARTITION BY document_id, source_type ORDER BY pos) AS nth, stack[-1] AS parent_pos, page_idx, text, stack FROM k WHERE source_type IN ('table', 'image') AND page_role <> 'toc'"""
Q = """SELECT document_id, pos, 0 AS first, 'section' AS part, parent_pos, 'report:' || document_id || ':section:' || nth AS uid, NULL AS text, NULL AS page, NULL AS stack FROM x
 UNION ALL SELECT document_id, pos, 1, 'unit', parent_pos, 'report:' || document_id || ':unit:' || nth, text, unit_page, stack FROM u
 UNION ALL SELECT document_id, pos, 1, part, parent_pos, 'report:' || document_id || ':' || part || ':' || nth, text, page_idx, stack FROM m"""
C = """SELECT x.document_id, x.pos, count(q.uid) AS members, coalesce(min(q.page), any_value(CASE WHEN x.source_type = 'title' THEN x.page_idx ELSE 1 END)) AS first_page,
 coalesce(max(q.page), any_value(CASE WHEN x.source_type = 'title' THEN x.page_idx ELSE 1 END)) AS last_page, coalesce(substr(string_agg(q.text, chr(10) ORDER BY q.pos), 1, 500), '') AS content_preview,
 coalesce(string_agg(q.uid, ',' ORDER BY q.pos), '') AS member_uids FROM x LEFT JOIN q ON q.document_id = x.document_id AND q.part <> 'section' AND list_contains(q.stack, x.pos) GROUP BY x.document_id, x.pos"""
PLANNED = {"b": B, "pages": PAGES, "pr": PR, "tf": TF, "tp": TP, "l": L, "s": S, "k": K, "r": R, "p": P, "f": F_, "u": U, "x": X}
CTES = {"doc_lines": DUCK_LINES, "plain_blocks": DOC_BLOCKS, "doc_blocks": HEADED_BLOCKS, **PLANNED}
MEDIA_CTES = {"doc_lines": DUCK_LINES, "plain_blocks": DOC_BLOCKS, "headed_blocks": HEADED_BLOCKS, "doc_blocks": MEDIA_BLOCKS, **PLANNED, "m": M, "q": Q, "c": C}


def query(name: str, sql: str | None, ctes: dict[str, str] = CTES):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = duck(sql, **ctes).replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return put


def headed_blocks(spark, sf) -> DataFrame:
    doc_blocks(spark, sf).createOrReplaceTempView("plain_blocks")
    return spark.sql(HEADED_BLOCKS)


def media_blocks(spark, sf) -> DataFrame:
    headed_blocks(spark, sf).createOrReplaceTempView("headed_blocks")
    return spark.sql(MEDIA_BLOCKS)


def rows_of(spark, sf, blocks=headed_blocks) -> DataFrame:
    return cut_lineage(report.page_roles(report.normalized(blocks(spark, sf))))


def under_plan(spark, sf, blocks=headed_blocks) -> DataFrame:
    """Blocks under the outline that the titles' plan gives."""
    rows = rows_of(spark, sf, blocks)
    return cut_lineage(report.planned(rows, report.title_plan(rows)))


def parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    stacked = under_plan(spark, sf)
    return report.sections(stacked), cut_lineage(report.text_units(stacked))


def media_parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, units, and tables with figures: of their normalized texts, the given ones are left behind."""
    rows = cut_lineage(report.page_roles(report.normalized(media_blocks(spark, sf)).drop("text")))
    stacked = cut_lineage(report.planned(rows, report.title_plan(rows)))
    return report.sections(stacked), cut_lineage(report.text_units(stacked)), report.media(stacked)


@query("report_blocks", "SELECT document_id, pos, source_type, text AS text_normalized FROM b")
def report_blocks(spark, sf) -> DataFrame:
    return report.normalized(headed_blocks(spark, sf)).select("document_id", "pos", "source_type", "text_normalized")


@query("page_roles", "SELECT DISTINCT document_id, page_idx, page_role FROM pr")
def page_roles(spark, sf) -> DataFrame:
    return rows_of(spark, sf).select("document_id", "page_idx", "page_role").distinct()


@query("report_title_plan", "SELECT document_id, pos, kind, level, ref, structural FROM tp WHERE i > 0")
def report_title_plan(spark, sf) -> DataFrame:
    return report.title_plan(rows_of(spark, sf)).select("document_id", "pos", "kind", "level", "ref", "structural")


@query("section_outline", """
SELECT document_id, pos, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS nth, level, stack[-2] AS parent_pos, len(stack) AS depth FROM k WHERE level IS NOT NULL""")
def section_outline(spark, sf) -> DataFrame:
    return report.sections(under_plan(spark, sf)).select("document_id", "pos", "nth", "level", "parent_pos", F.size("path").cast("long").alias("depth"))


@query("text_units", "SELECT document_id, nth, text, blocks, first_page, last_page, parent_pos FROM u")
def text_units(spark, sf) -> DataFrame:
    return parts(spark, sf)[1].select("document_id", "nth", "text", "blocks", "first_page", "last_page", "parent_pos")


@query("section_contents", """
SELECT k.document_id, k.pos, count(u.nth) AS members, coalesce(min(unit_page), any_value(CASE WHEN k.source_type = 'title' THEN k.page_idx ELSE 1 END)) AS first_page, coalesce(max(unit_page), any_value(CASE WHEN k.source_type = 'title' THEN k.page_idx ELSE 1 END)) AS last_page,
 coalesce(substr(string_agg(u.text, chr(10) ORDER BY u.pos), 1, 500), '') AS content_preview FROM k LEFT JOIN u ON u.document_id = k.document_id AND list_contains(u.stack, k.pos) WHERE k.level IS NOT NULL GROUP BY k.document_id, k.pos""")
def section_contents(spark, sf) -> DataFrame:
    found, units = parts(spark, sf)
    return report.section_contents(found, units).select("document_id", "pos", "members", "first_page", "last_page", "content_preview")


@query("implicit_sections", "SELECT x.document_id, count(u.nth) AS units FROM x LEFT JOIN u ON u.document_id = x.document_id AND u.parent_pos = x.pos WHERE x.source_type <> 'title' GROUP BY ALL")
def implicit_sections(spark, sf) -> DataFrame:
    return report.implicit_sections(*parts(spark, sf)).select("document_id", "units")


@query("order_index", """
SELECT document_id, pos, part, row_number() OVER (PARTITION BY document_id ORDER BY pos, part) AS order_index FROM (SELECT document_id, pos, 'unit' AS part FROM u UNION ALL SELECT document_id, pos, 'section' FROM k WHERE level IS NOT NULL)""")
def order_index(spark, sf) -> DataFrame:
    return report.ordered_parts(*parts(spark, sf)).select("document_id", "pos", "part", "order_index")


@query("text_only_units", "SELECT document_id, nth, blocks FROM u WHERE (document_id, pos) IN (SELECT document_id, pos FROM b WHERE source_type = 'paragraph')")
def text_only_units(spark, sf) -> DataFrame:
    return parts(spark, sf)[1].where("unit_type = 'text'").select("document_id", "nth", "blocks")


@query("section_scopes", """
SELECT document_id, CASE WHEN parent_pos IS NULL THEN 'u' || nth ELSE 's' || parent_pos END AS scope, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, count(*) AS units, min(first_page) AS first_page, max(last_page) AS last_page FROM u
WHERE (document_id, pos) IN (SELECT document_id, pos FROM b WHERE source_type = 'paragraph') GROUP BY ALL""")
def section_scopes(spark, sf) -> DataFrame:
    found, units = parts(spark, sf)
    made = report.scopes(units, found)
    at = found.select("document_id", F.col("section_uid").alias("scope_uid"), F.col("pos").alias("at"))
    own = made.join(at, ["document_id", "scope_uid"], "left")
    scope = F.when(F.col("at").isNull(), F.concat(F.lit("u"), F.substring_index("scope_uid", ":", -1))).otherwise(F.concat(F.lit("s"), F.col("at").cast("string")))
    return own.select("document_id", scope.alias("scope"), "text", "units", "first_page", "last_page")


@query("report_graph_edges", """
SELECT document_id, 'CONTAINS' AS edge_type, count(*) AS n FROM (SELECT document_id, pos FROM u UNION ALL SELECT document_id, pos FROM k WHERE level IS NOT NULL) GROUP BY ALL
UNION ALL SELECT document_id, 'NEXT', sum(c - 1) FROM (SELECT document_id, parent, count(*) AS c FROM (SELECT document_id, parent_pos AS parent FROM u UNION ALL SELECT document_id, stack[-2] FROM k WHERE level IS NOT NULL) GROUP BY ALL) GROUP BY ALL HAVING sum(c - 1) > 0""")
def report_graph_edges(spark, sf) -> DataFrame:
    return report.report_edges(*parts(spark, sf)).groupBy("document_id", "edge_type").agg(F.count("*").alias("n"))


@query("report_graph_nodes", """
SELECT document_id, 'report' AS node_type, 1 AS n FROM (SELECT document_id FROM u UNION SELECT document_id FROM x) UNION ALL SELECT document_id, 'report_unit', count(*) FROM u GROUP BY ALL
UNION ALL SELECT document_id, 'report_section', count(*) FROM k WHERE level IS NOT NULL GROUP BY ALL""")
def report_graph_nodes(spark, sf) -> DataFrame:
    return report.report_nodes(*parts(spark, sf)).groupBy("document_id", "node_type").agg(F.count("*").alias("n"))


@query("report_metrics", """
SELECT document_id, front_matter_pages, toc_pages, body_pages, coalesce(units, 0) AS units, coalesce(front_matter_units, 0) AS front_matter_units, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["sections", *(f"{k}_sections" for k in report.KINDS)]) + """ FROM
(SELECT document_id, """ + ", ".join(f"count(DISTINCT CASE WHEN page_role = '{r}' THEN page_idx END) AS {r}_pages" for r in ("front_matter", "toc", "body")) + """ FROM pr GROUP BY ALL) LEFT JOIN
(SELECT document_id, count(*) AS sections, """ + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_sections" for k in report.KINDS) + """ FROM x GROUP BY ALL) USING (document_id) LEFT JOIN
(SELECT document_id, count(*) AS units, count(*) FILTER (page_role = 'front_matter') AS front_matter_units FROM u GROUP BY ALL) USING (document_id)""")
def report_metrics(spark, sf) -> DataFrame:
    stacked = under_plan(spark, sf)
    return report.report_metrics(stacked, report.sections(stacked), report.text_units(stacked))


@query("nearest_text", """
SELECT document_id, pos, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 177)) || '...' END AS before FROM (SELECT document_id, pos, source_type, last_value(CASE WHEN source_type <> 'title' AND page_role <> 'toc' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM pr) WHERE source_type = 'title'""")
def nearest_text(spark, sf) -> DataFrame:
    return report.text_previews(rows_of(spark, sf)).select("document_id", "pos", "before")


@query("report_media", "SELECT document_id, pos, part, nth, parent_pos, page_idx, text FROM m", MEDIA_CTES)
def report_media(spark, sf) -> DataFrame:
    return report.media(under_plan(spark, sf, media_blocks)).select("document_id", "pos", "part", "nth", "parent_pos", "page_idx", "text")


@query("report_parts_in_order", "SELECT document_id, uid, part, row_number() OVER (PARTITION BY document_id ORDER BY pos, first) AS order_index FROM q", MEDIA_CTES)
def report_parts_in_order(spark, sf) -> DataFrame:
    return report.ordered_parts(*media_parts(spark, sf)).select("document_id", "uid", "part", "order_index")


@query("report_section_members", "SELECT document_id, pos, members, first_page, last_page, content_preview, member_uids FROM c", MEDIA_CTES)
def report_section_members(spark, sf) -> DataFrame:
    return report.section_contents(*media_parts(spark, sf)).select("document_id", "pos", "members", "first_page", "last_page", "content_preview", F.array_join("member_uids", ",").alias("member_uids"))


@query("front_matter_sections", """
SELECT x.document_id, 'report:' || x.document_id || ':section:' || x.nth AS section_uid, x.title, count(u.nth) AS units FROM x LEFT JOIN u ON u.document_id = x.document_id AND u.parent_pos = x.pos WHERE x.source_type <> 'title' GROUP BY ALL""", MEDIA_CTES)
def front_matter_sections(spark, sf) -> DataFrame:
    found, units, _ = media_parts(spark, sf)
    return report.implicit_sections(found, units).select("document_id", "section_uid", "title", "units")


@query("report_space_nodes", """
SELECT DISTINCT document_id, 'report:' || document_id AS node_uid, 'report' AS node_type, document_id AS label, document_id AS text_content FROM q
UNION ALL SELECT document_id, uid, 'report_' || part, CASE part WHEN 'unit' THEN substr(text, 1, 80) ELSE uid END, text FROM q WHERE part <> 'section'
UNION ALL SELECT x.document_id, 'report:' || x.document_id || ':section:' || x.nth, 'report_section', x.title, coalesce(any_value(sp) || chr(10), '') || x.title || CASE WHEN any_value(content_preview) <> '' THEN chr(10) || any_value(content_preview) ELSE '' END
 FROM x JOIN c USING (document_id, pos) LEFT JOIN (SELECT x.document_id, x.pos, string_agg(y.title, ' > ' ORDER BY y.pos) AS sp FROM x JOIN x AS y ON y.document_id = x.document_id AND list_contains(x.stack, y.pos) AND y.structural GROUP BY ALL) USING (document_id, pos)
 GROUP BY x.document_id, x.nth, x.title""", MEDIA_CTES)
def report_space_nodes(spark, sf) -> DataFrame:
    return report.report_nodes(*media_parts(spark, sf))


@query("report_space_edges", """
WITH placed AS (SELECT q.*, coalesce(p.uid, 'report:' || q.document_id) AS parent_uid FROM q LEFT JOIN q AS p ON p.document_id = q.document_id AND p.part = 'section' AND p.pos = q.parent_pos)
SELECT document_id, 'CONTAINS' AS edge_type, parent_uid AS source_uid, uid AS target_uid FROM placed
UNION ALL SELECT * FROM (SELECT document_id, 'NEXT', uid, lead(uid) OVER (PARTITION BY document_id, parent_uid ORDER BY pos, first) AS following FROM placed) WHERE following IS NOT NULL""", MEDIA_CTES)
def report_space_edges(spark, sf) -> DataFrame:
    return report.report_edges(*media_parts(spark, sf)).select("document_id", "edge_type", "source_uid", "target_uid")


@query("report_space_metrics", """
SELECT document_id, sections, topic_sections, front_matter_sections, units, tables, figures FROM (SELECT document_id, count(*) AS sections, count(*) FILTER (kind = 'topic') AS topic_sections, count(*) FILTER (kind = 'front_matter') AS front_matter_sections FROM x GROUP BY ALL)
JOIN (SELECT document_id, count(*) FILTER (part = 'unit') AS units, count(*) FILTER (part = 'table') AS tables, count(*) FILTER (part = 'figure') AS figures FROM q GROUP BY ALL) USING (document_id)""", MEDIA_CTES)
def report_space_metrics(spark, sf) -> DataFrame:
    stacked = under_plan(spark, sf, media_blocks)
    measured = report.report_metrics(stacked, report.sections(stacked), report.text_units(stacked), report.media(stacked))
    return measured.select("document_id", "sections", "topic_sections", "front_matter_sections", "units", "tables", "figures")


@query("report_space_sections", """
WITH o AS (SELECT document_id, uid, row_number() OVER (PARTITION BY document_id ORDER BY pos, first) AS order_index FROM q),
paths AS (SELECT x.document_id, x.pos, string_agg(y.title, ' > ' ORDER BY y.pos) AS path FROM x JOIN x AS y ON y.document_id = x.document_id AND list_contains(x.stack, y.pos) GROUP BY ALL)
SELECT x.document_id, 'report:' || x.document_id || ':section:' || x.nth AS section_uid, 'report:' || x.document_id || ':section:' || p.nth AS parent_section_uid, x.title, x.kind AS section_kind,
 path, order_index, first_page, last_page, members AS member_count FROM x JOIN c USING (document_id, pos) JOIN paths USING (document_id, pos) LEFT JOIN x AS p ON p.document_id = x.document_id AND p.pos = x.parent_pos JOIN o ON o.uid = 'report:' || x.document_id || ':section:' || x.nth""", MEDIA_CTES)
def report_space_sections(spark, sf) -> DataFrame:
    shown = report.space_view(*media_parts(spark, sf))[0]
    return shown.select("document_id", "section_uid", "parent_section_uid", "title", "section_kind", F.array_join("path", " > ").alias("path"), "order_index", F.col("page_span")[0].alias("first_page"), F.col("page_span")[1].alias("last_page"), "member_count")


@query("report_space_units", """
WITH o AS (SELECT document_id, uid, row_number() OVER (PARTITION BY document_id ORDER BY pos, first) AS order_index FROM q)
SELECT u.document_id, 'report:' || u.document_id || ':unit:' || u.nth AS unit_uid, 'report:' || u.document_id || ':section:' || x.nth AS parent_section_uid, text, order_index, first_page, last_page
 FROM u JOIN x ON x.document_id = u.document_id AND x.pos = u.parent_pos JOIN o ON o.uid = 'report:' || u.document_id || ':unit:' || u.nth""", MEDIA_CTES)
def report_space_units(spark, sf) -> DataFrame:
    shown = report.space_view(*media_parts(spark, sf))[1]
    return shown.select("document_id", "unit_uid", "parent_section_uid", "text", "order_index", F.col("page_span")[0].alias("first_page"), F.col("page_span")[1].alias("last_page"))
