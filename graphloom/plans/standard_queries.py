"""Registered queries over normative standards (binding ``spec_blocks``), each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import normative as N
from graphloom.operators import graph_build, outline, requirements
from graphloom.sources.bindings import SPEC_BLOCKS, bound, duck, spec_blocks
from graphloom.sources.stage import cut_lineage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

B = """SELECT *, row_number() OVER (PARTITION BY standard_uid ORDER BY page_idx, block_idx, item_idx) AS pos,
 printf('p%03d-b%03d', page_idx, block_idx) || CASE WHEN item_idx > 0 THEN printf('-i%02d', item_idx) ELSE '' END AS block_id,
 CASE WHEN source_type = 'title' AND regexp_matches(text, '^\\d+\\.\\d+\\s') THEN 'section' WHEN source_type = 'title' AND regexp_matches(text, '^\\d+\\s') THEN 'chapter' END AS kind,
 regexp_extract(text, '^(\\d+(\\.\\d+)?)\\s+(.+)$', 1) AS ref, regexp_extract(text, '^(\\d+(\\.\\d+)?)\\s+(.+)$', 3) AS title,
 nullif(regexp_extract(text, '^(\\d+\\.\\d+\\.\\d+)', 1), '') AS clause_ref FROM spec_blocks"""
S = """SELECT *, count(clause_ref) OVER w AS segment, last_value(clause_ref IGNORE NULLS) OVER w AS current_ref, lead(source_type) OVER w2 AS next_type, lead(text) OVER w2 AS next_text
 FROM b WINDOW w AS (PARTITION BY standard_uid ORDER BY pos ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY standard_uid ORDER BY pos)"""
R = """SELECT *, kind = 'chapter' AND segment > 0 AND (TRY_CAST(ref AS BIGINT) < TRY_CAST(split_part(current_ref, '.', 1) AS BIGINT) OR (TRY_CAST(ref AS BIGINT) <> TRY_CAST(split_part(current_ref, '.', 1) AS BIGINT) AND (ends_with(text, '：') OR contains(text, '如下')
 OR coalesce(next_type = 'table' OR regexp_matches(next_text, '^(\\(?\\d+\\)?(\\s|$)|\\d+）|\\d+\\.(\\D|$))') OR starts_with(next_text, '表'), false)))) AS rejected FROM s"""
A = """SELECT *, kind IS NOT NULL AND (segment = 0 OR seen) AS accepted, segment > 0 AND NOT seen AS in_clause FROM
 (SELECT *, coalesce(max(CASE WHEN kind IS NOT NULL AND NOT rejected THEN 1 ELSE 0 END) OVER (PARTITION BY standard_uid, segment ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) = 1 AS seen FROM r)"""
O = """SELECT *, last_value(CASE WHEN accepted AND kind = 'chapter' THEN pos END IGNORE NULLS) OVER w AS chapter_pos, last_value(CASE WHEN accepted AND kind = 'section' THEN pos END IGNORE NULLS) OVER w AS section_pos FROM a
 WINDOW w AS (PARTITION BY standard_uid ORDER BY pos ROWS UNBOUNDED PRECEDING)"""
X = """SELECT o.*, c.ref AS chapter_ref, c.title AS chapter_title, CASE WHEN o.section_pos > o.chapter_pos THEN q.ref END AS section_ref, CASE WHEN o.section_pos > o.chapter_pos THEN q.title END AS section_title
 FROM o LEFT JOIN b c ON c.standard_uid = o.standard_uid AND c.pos = o.chapter_pos LEFT JOIN b q ON q.standard_uid = o.standard_uid AND q.pos = o.section_pos"""
#: Structure nodes, clauses with their texts, list items with their ordinals, requirements.
H = """SELECT standard_uid, pos, standard_uid || ':' || kind || ':' || ref AS node_uid, kind AS node_type, ref, title, text AS raw_text,
 CASE WHEN kind = 'section' THEN standard_uid || ':chapter:' || chapter_ref END AS parent_uid FROM x WHERE accepted"""
C = """SELECT standard_uid, segment, min(pos) AS pos, standard_uid || ':main:' || max(clause_ref) AS clause_uid, max(clause_ref) AS clause_ref, max(CASE WHEN clause_ref IS NOT NULL THEN chapter_ref END) AS chapter_ref,
 max(CASE WHEN clause_ref IS NOT NULL THEN section_ref END) AS section_ref, max(CASE WHEN clause_ref IS NOT NULL THEN chapter_title || ' > ' || section_title END) AS heading,
 string_agg(text, chr(10) ORDER BY pos) AS source_text, min(page_idx) AS first_page, max(page_idx) AS last_page, count(*) AS blocks,
 count(*) FILTER (source_type = 'list_item') AS items, count(*) FILTER (source_type = 'table') AS tables, count(*) FILTER (source_type = 'title') AS continuations FROM x WHERE in_clause GROUP BY standard_uid, segment"""
I = """SELECT x.standard_uid, x.segment, row_number() OVER (PARTITION BY x.standard_uid, x.segment ORDER BY x.pos) AS nth, regexp_extract(text, '^\\d+）(.*)$', 1) AS item FROM x WHERE in_clause AND source_type = 'list_item'"""
Q = """SELECT c.*, coalesce(nth, 1) AS nth, CASE WHEN nth IS NULL THEN regexp_replace(replace(source_text, chr(10), ' '), '^\\d+\\.\\d+\\.\\d+\\s*', '')
  ELSE regexp_extract(split_part(source_text, chr(10), 1), '^\\d+\\.\\d+\\.\\d+\\s*(.*)应包括', 1) || '应包括' || rtrim(item, '；') || '。' END AS requirement_text,
 CASE WHEN contains(source_text, '不得') THEN 'forbidden' ELSE 'must' END AS modality,
 CAST(least(95 - CASE WHEN continuations > 0 THEN 8 ELSE 0 END - CASE WHEN blocks > 6 THEN 5 ELSE 0 END, CASE WHEN nth IS NULL THEN 90 ELSE 82 END) AS DOUBLE) / 100 AS confidence FROM c LEFT JOIN i USING (standard_uid, segment)"""
CTES = {"spec_blocks": SPEC_BLOCKS, "b": B, "s": S, "r": R, "a": A, "o": O, "x": X, "h": H, "c": C, "i": I, "q": Q}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = duck(sql, **CTES)
        return f

    return put


def rows_of(spark, sf) -> DataFrame:
    return outline.outline(outline.with_decisions(outline.normalized_blocks(spec_blocks(spark, sf))))


def parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(structure, clauses, requirements); what all three come from is computed once."""
    rows = cut_lineage(rows_of(spark, sf))
    found = cut_lineage(outline.clauses(rows))
    return outline.structure_nodes(rows), found, requirements.requirements(found)


@query("block_ids", "SELECT standard_uid, block_id, pos, text AS text_normalized FROM b")
def block_ids(spark, sf) -> DataFrame:
    return outline.normalized_blocks(spec_blocks(spark, sf)).select("standard_uid", "block_id", "pos", "text_normalized")


@query("title_kinds", "SELECT standard_uid, block_id, kind AS node_type, ref, title FROM b WHERE kind IS NOT NULL")
def title_kinds(spark, sf) -> DataFrame:
    rows = outline.with_decisions(outline.normalized_blocks(spec_blocks(spark, sf)))
    return rows.where("info IS NOT NULL").select("standard_uid", "block_id", "info.*")


@query("title_label_counts", "SELECT standard_uid, kind AS label, count(*) AS n FROM b WHERE kind IS NOT NULL GROUP BY ALL")
def title_label_counts(spark, sf) -> DataFrame:
    rows = outline.with_decisions(outline.normalized_blocks(spec_blocks(spark, sf)))
    return rows.where("info IS NOT NULL").groupBy("standard_uid", F.col("info.node_type").alias("label")).agg(F.count("*").alias("n"))


@query("title_inventory", """
SELECT t.standard_uid, t.block_id AS title_id, row_number() OVER (PARTITION BY t.standard_uid ORDER BY t.pos) AS "index", lag(t.text) OVER (PARTITION BY t.standard_uid ORDER BY t.pos) AS prev_title,
 lead(t.text) OVER (PARTITION BY t.standard_uid ORDER BY t.pos) AS next_title, p.text AS prev_preview, n.text AS next_preview FROM b t
LEFT JOIN b p ON p.standard_uid = t.standard_uid AND p.pos = t.pos - 1 LEFT JOIN b n ON n.standard_uid = t.standard_uid AND n.pos = t.pos + 1 WHERE t.source_type = 'title'""")
def title_inventory(spark, sf) -> DataFrame:
    found = outline.title_inventory(outline.normalized_blocks(spec_blocks(spark, sf)))
    return found.select("standard_uid", "title_id", "index", "prev_title", "next_title", "prev_preview", "next_preview")


@query("outline_state", "SELECT standard_uid, pos, chapter_ref, section_ref, CASE WHEN chapter_pos IS NULL THEN 'front_matter' ELSE 'main' END AS body_kind, in_clause, accepted FROM x")
def outline_state(spark, sf) -> DataFrame:
    return rows_of(spark, sf).select("standard_uid", "pos", F.col("chapter.ref").alias("chapter_ref"), F.col("section.ref").alias("section_ref"), "body_kind", "in_clause", "accepted")


@query("structure_nodes", "SELECT standard_uid, node_uid, node_type, ref, title, raw_text, parent_uid FROM h")
def structure_nodes(spark, sf) -> DataFrame:
    return outline.structure_nodes(rows_of(spark, sf)).select("standard_uid", "node_uid", "node_type", "ref", "title", "raw_text", "parent_uid")


@query("clauses", """
SELECT standard_uid, clause_uid, clause_ref, chapter_ref, section_ref, heading AS heading_path, source_text, first_page, last_page, blocks, items, tables,
 CAST(95 - CASE WHEN continuations > 0 THEN 8 ELSE 0 END - CASE WHEN blocks > 6 THEN 5 ELSE 0 END AS DOUBLE) / 100 AS confidence FROM c""")
def clauses(spark, sf) -> DataFrame:
    c = outline.clauses(rows_of(spark, sf))
    return c.select("standard_uid", "clause_uid", "clause_ref", "chapter_ref", "section_ref", F.array_join("heading_path", " > ").alias("heading_path"), "source_text", "first_page", "last_page",
                    F.size("source_block_ids").cast("long").alias("blocks"), F.size("list_items").cast("long").alias("items"), F.size("tables").cast("long").alias("tables"), F.col("segmentation_confidence").alias("confidence"))


@query("clause_tables", "SELECT standard_uid, clause_uid || '#table1' AS table_uid, regexp_extract(x.text, '^表 (\\S+)', 1) AS table_ref FROM x JOIN c USING (standard_uid, segment) WHERE source_type = 'table' AND in_clause")
def clause_tables(spark, sf) -> DataFrame:
    return outline.clauses(rows_of(spark, sf)).select("standard_uid", F.explode("tables").alias("t")).select("standard_uid", "t.table_uid", "t.table_ref")


@query("standard_metrics", """
SELECT standard_uid, blocks, structure_nodes, rejected_titles, orphans, coalesce(clauses, 0) AS clauses, coalesce(clauses, 0) AS main_clauses, 0 AS appendix_clauses, coalesce(tables, 0) AS tables, coalesce(continuations, 0) AS continuations FROM
(SELECT standard_uid, count(*) AS blocks, count(*) FILTER (accepted) AS structure_nodes, count(*) FILTER (kind IS NOT NULL AND NOT accepted) AS rejected_titles, count(*) FILTER (NOT accepted AND NOT in_clause) AS orphans FROM x GROUP BY ALL)
LEFT JOIN (SELECT standard_uid, count(*) AS clauses, sum(tables) AS tables, sum(continuations) AS continuations FROM c GROUP BY ALL) USING (standard_uid)""")
def standard_metrics(spark, sf) -> DataFrame:
    rows = cut_lineage(rows_of(spark, sf))
    return outline.standard_metrics(rows, outline.clauses(rows))


@query("duplicate_clauses", "SELECT standard_uid, clause_uid, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 1")
def duplicate_clauses(spark, sf) -> DataFrame:
    return outline.duplicate_clauses(outline.clauses(rows_of(spark, sf)))


@query("eligible_clauses", "SELECT standard_uid, clause_uid FROM c WHERE chapter_ref IS NOT NULL")
def eligible_clauses(spark, sf) -> DataFrame:
    return outline.eligible(outline.clauses(rows_of(spark, sf))).select("standard_uid", "clause_uid")


@query("requirements", """
SELECT standard_uid, clause_uid || '#r' || nth AS requirement_uid, requirement_text, modality, confidence,
 CASE WHEN items = 0 THEN regexp_extract(requirement_text, '^(.*)应包括', 1) ELSE regexp_extract(requirement_text, '^(.*)应包括', 1) END AS subject,
 CASE WHEN contains(requirement_text, 'GB') THEN 'GB' || regexp_extract(requirement_text, 'GB (\\d+-\\d+)', 1) ELSE '' END AS cited,
 CASE WHEN contains(requirement_text, '监测') THEN '监测资料,监测报告,监测记录' ELSE '相关说明资料' END AS evidence FROM q""")
def requirement_rows(spark, sf) -> DataFrame:
    r = parts(spark, sf)[2]
    return r.select("standard_uid", "requirement_uid", "requirement_text", "modality", "confidence", "subject", F.array_join("cited_targets.standard_code", ",").alias("cited"), F.array_join("evidence_expected", ",").alias("evidence"))


@query("requirement_counts", "SELECT standard_uid, clause_uid, greatest(items, 1) AS requirement_count FROM c")
def requirement_counts(spark, sf) -> DataFrame:
    _, found, asked = parts(spark, sf)
    return requirements.counts_by_clause(found, asked)


@query("modality_counts", "SELECT standard_uid, modality, count(*) AS n FROM q GROUP BY ALL")
def modality_counts(spark, sf) -> DataFrame:
    return parts(spark, sf)[2].groupBy("standard_uid", "modality").agg(F.count("*").alias("n"))


@query("requirement_detail", """
SELECT 'sn1:2024' AS standard_id, clause_uid || '#r' || nth AS requirement_uid, requirement_text, clause_ref, first_page, last_page FROM q WHERE standard_uid = 'sn1:2024' AND clause_ref = '1.1.2' AND nth = 1""")
def requirement_detail(spark, sf) -> DataFrame:
    _, found, asked = parts(spark, sf)
    own = asked.where("requirement_uid = 'sn1:2024:main:1.1.2#r1'").join(found.select("standard_uid", F.col("clause_uid").alias("parent_clause_uid"), "first_page", "last_page"), ["standard_uid", "parent_clause_uid"])
    return own.select(F.substring_index("requirement_uid", ":", 2).alias("standard_id"), "requirement_uid", "requirement_text", "clause_ref", "first_page", "last_page")


@query("clause_batches", "SELECT standard_uid, clause_uid, (row_number() OVER (PARTITION BY standard_uid ORDER BY pos) - 1) // 6 AS batch FROM c")
def clause_batches(spark, sf) -> DataFrame:
    return requirements.batches(outline.clauses(rows_of(spark, sf)), 6, "pos").select("standard_uid", "clause_uid", "batch")


@query("request_payloads", """
SELECT standard_uid, batch, count(*) AS n, string_agg(clause_uid, ',' ORDER BY pos) AS uids FROM (SELECT *, (row_number() OVER (PARTITION BY standard_uid ORDER BY pos) - 1) // 6 AS batch FROM c) GROUP BY ALL""")
def request_payloads(spark, sf) -> DataFrame:
    made = requirements.request_payloads(outline.clauses(rows_of(spark, sf)))
    asked = F.from_json("payload", "standard_uid string, clauses array<struct<clause_uid:string>>")
    return made.select("standard_uid", "batch", "n", F.array_join(asked["clauses"]["clause_uid"], ",").alias("uids"))


@query("returned_items", """
SELECT standard_uid, count(*) AS requested, count(*) FILTER (NOT lost) AS succeeded, count(*) FILTER (lost) AS failed FROM (SELECT *, (hash_ref % 5) = 0 AS lost FROM (SELECT *, CAST(split_part(clause_ref, '.', 3) AS INTEGER) + first_page AS hash_ref FROM c)) GROUP BY ALL""")
def returned_items(spark, sf) -> DataFrame:
    found = cut_lineage(outline.clauses(rows_of(spark, sf)))
    lost = (F.substring_index("clause_ref", ".", -1).cast("int") + F.col("first_page")) % 5 == 0
    back, failed = requirements.returned_or_failed(found, found.where(~lost).select("standard_uid", "clause_uid"))
    counts = back.select("standard_uid", F.lit(1).alias("ok")).unionByName(failed.select("standard_uid", F.lit(0).alias("ok")))
    return counts.groupBy("standard_uid").agg(F.count("*").alias("requested"), F.sum("ok").alias("succeeded"), F.sum(1 - F.col("ok")).alias("failed"))


@query("hybrid_requirements", """
SELECT standard_uid, path, count(*) AS n FROM (SELECT standard_uid, 'model' AS path FROM c WHERE first_page % 2 = 0 UNION ALL SELECT standard_uid, 'heuristic' FROM q WHERE first_page % 2 = 1) GROUP BY ALL""")
def hybrid_requirements(spark, sf) -> DataFrame:
    found = cut_lineage(outline.clauses(rows_of(spark, sf)))
    none, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    asked = F.struct(F.concat(F.col("clause_ref"), F.lit(" 应记录")).alias("requirement_text"), none.alias("modality"), none.alias("subject"), texts.alias("action"), texts.alias("object"), texts.alias("evidence_expected"),
                     F.lit(None).cast("array<struct<standard_code:string,clause_ref:string,citation_type:string>>").alias("cited_targets"), none.alias("confidence"))
    items = found.where("first_page % 2 = 0").select("standard_uid", "clause_uid", F.array(asked).alias("requirements"))
    return requirements.with_fallback(found, items).groupBy("standard_uid", "path").agg(F.count("*").alias("n"))


@query("standard_graph_nodes", """
SELECT standard_uid, node_type, count(DISTINCT uid) AS n FROM (SELECT standard_uid, node_type, node_uid AS uid FROM h UNION ALL SELECT DISTINCT standard_uid, 'standard', standard_uid FROM b UNION ALL SELECT standard_uid, 'clause', clause_uid FROM c
 UNION ALL SELECT standard_uid, 'table', clause_uid FROM c WHERE tables > 0 UNION ALL SELECT standard_uid, 'requirement', clause_uid || '#r' || nth FROM q
 UNION ALL SELECT q.standard_uid, 'concept', unnest([split_part(heading, ' > ', 1), split_part(heading, ' > ', 2)] || CASE WHEN contains(source_text, '监测') THEN ['监测'] ELSE [] END) FROM q
 UNION ALL SELECT standard_uid, 'reference_standard', regexp_extract(requirement_text, 'GB (\\d+-\\d+)', 1) FROM q WHERE contains(requirement_text, 'GB')) GROUP BY ALL""")
def standard_graph_nodes(spark, sf) -> DataFrame:
    return graph_build.standard_nodes(*parts(spark, sf)).groupBy("standard_uid", "node_type").agg(F.count("*").alias("n"))


#: Children by parent in append order, and the edges of a standard graph by type.
K = """SELECT standard_uid, coalesce(parent_uid, standard_uid) AS source_uid, node_uid AS target_uid, 1 AS kind, pos FROM h UNION ALL
 SELECT standard_uid, coalesce(CASE WHEN section_ref IS NOT NULL THEN standard_uid || ':section:' || section_ref WHEN chapter_ref IS NOT NULL THEN standard_uid || ':chapter:' || chapter_ref END, standard_uid), clause_uid, 2, pos FROM c
 UNION ALL SELECT standard_uid, clause_uid, clause_uid || '#table1', 2, pos FROM c WHERE tables > 0"""
G = """SELECT DISTINCT standard_uid, 'CONTAINS' AS edge_type, source_uid, target_uid FROM k
 UNION SELECT standard_uid, 'NEXT', target_uid, following FROM (SELECT *, lead(target_uid) OVER (PARTITION BY standard_uid, source_uid ORDER BY kind, pos) AS following FROM k) WHERE following IS NOT NULL
 UNION SELECT standard_uid, 'DERIVES_REQUIREMENT', clause_uid, clause_uid || '#r' || nth FROM q
 UNION SELECT standard_uid, 'ABOUT', clause_uid || '#r' || nth, unnest([split_part(heading, ' > ', 1), split_part(heading, ' > ', 2)] || CASE WHEN contains(source_text, '监测') THEN ['监测'] ELSE [] END) FROM q
 UNION SELECT standard_uid, 'CITES_STANDARD', clause_uid || '#r' || nth, regexp_extract(requirement_text, 'GB (\\d+-\\d+)', 1) FROM q WHERE contains(requirement_text, 'GB')"""
CTES |= {"k": K, "g": G}


@query("standard_graph_edges", "SELECT standard_uid, edge_type, count(*) AS n FROM g GROUP BY ALL")
def standard_graph_edges(spark, sf) -> DataFrame:
    return graph_build.standard_edges(*parts(spark, sf)).groupBy("standard_uid", "edge_type").agg(F.count("*").alias("n"))


@query("next_edges", "SELECT standard_uid, 'edge:' || substr(sha1('NEXT|' || source_uid || '|' || target_uid), 1, 16) AS edge_uid, source_uid, target_uid FROM g WHERE edge_type = 'NEXT'")
def next_edges(spark, sf) -> DataFrame:
    structure, found, _ = parts(spark, sf)
    e = graph_build.next_edges(graph_build.children(structure, found)).withColumn("edge_uid", N.edge_uid(F.col("edge_type"), F.col("source_uid"), F.col("target_uid")))
    return e.select("standard_uid", "edge_uid", "source_uid", "target_uid").distinct()


#: Every node of a standard's graph with its text, one row a uid.
E = """SELECT DISTINCT standard_uid, 'standard' AS node_type, standard_uid AS uid, standard_uid AS text FROM b UNION ALL SELECT DISTINCT standard_uid, 'chapter', node_uid, raw_text FROM h WHERE node_type = 'chapter' UNION ALL SELECT standard_uid, 'section', node_uid, raw_text FROM h WHERE node_type = 'section'
 UNION ALL SELECT standard_uid, 'clause', clause_uid, trim(heading || chr(10) || clause_ref || ' ' || source_text) FROM c
 UNION ALL SELECT c.standard_uid, 'table', clause_uid || '#table1', trim(heading || chr(10) || c.clause_ref || chr(10) || x.text) FROM c JOIN x USING (standard_uid, segment) WHERE source_type = 'table' AND in_clause
 UNION ALL SELECT standard_uid, 'requirement', clause_uid || '#r' || nth, requirement_text FROM q
 UNION ALL SELECT DISTINCT standard_uid, 'concept', concept, concept FROM (SELECT standard_uid, unnest([split_part(heading, ' > ', 1), split_part(heading, ' > ', 2)] || CASE WHEN contains(source_text, '监测') THEN ['监测'] ELSE [] END) AS concept FROM q)
 UNION ALL SELECT DISTINCT standard_uid, 'reference_standard', code, code FROM (SELECT standard_uid, 'GB' || regexp_extract(requirement_text, 'GB (\\d+-\\d+)', 1) AS code FROM q WHERE contains(requirement_text, 'GB'))"""


@query("embedding_inputs", f"SELECT standard_uid, node_type, count(*) AS n, sum(length(text)) AS chars FROM ({E}) GROUP BY ALL")
def embedding_inputs(spark, sf) -> DataFrame:
    nodes = graph_build.standard_nodes(*parts(spark, sf))
    return graph_build.embedding_inputs(nodes, None).groupBy("standard_uid", "node_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


DUCK_FILE = N.STANDARD_FILE.replace("(?iU)", "(?i)")
#: File names of standards, made of parts.
FILE_NAMES = """
SELECT p_partkey, concat(CAST(p_partkey AS VARCHAR(19)), CASE p_size % 3 WHEN 0 THEN '_' WHEN 1 THEN ' - ' ELSE '' END,
 CASE p_size % 6 WHEN 0 THEN 'GB ' WHEN 1 THEN 'sl' WHEN 2 THEN 'DL/T ' WHEN 3 THEN 'Sdj  ' WHEN 4 THEN 'SLJ' ELSE 'note ' END, CAST(p_partkey % 900 + 100 AS VARCHAR(9)), CASE WHEN p_size % 2 = 0 THEN '-' ELSE '—' END, CAST(1990 + p_size AS VARCHAR(9)),
 ' ', p_name, CASE p_size % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.doc' ELSE '.v2.pdf' END) AS name FROM part
"""


@query("file_descriptors", f"""
SELECT p_partkey, CASE WHEN ok THEN lower(replace(regexp_extract(name, '{DUCK_FILE}', 1), '/', '')) || regexp_extract(name, '{DUCK_FILE}', 2) || ':' || regexp_extract(name, '{DUCK_FILE}', 3) END AS standard_id,
 CASE WHEN ok THEN upper(regexp_extract(name, '{DUCK_FILE}', 1)) || regexp_extract(name, '{DUCK_FILE}', 2) END AS code, CASE WHEN ok THEN regexp_replace(stem, '^\\d+[_\\s-]*', '') END AS title,
 CASE WHEN lower(name) LIKE '%.docx' THEN 'docx' WHEN lower(name) LIKE '%.doc' THEN 'doc' ELSE 'pdf' END AS source_format, substr(trim(regexp_replace(lower(stem), '[^a-zA-Z0-9._-]+', '-', 'g'), '-'), 1, 80) AS slug
FROM (SELECT p_partkey, name, regexp_matches(name, '{DUCK_FILE}') AS ok, regexp_replace(string_split(name, '/')[-1], '\\.[^.]+$', '') AS stem FROM ({FILE_NAMES}))""")
def file_descriptors(spark, sf) -> DataFrame:
    named, name = bound(spark, sf, FILE_NAMES), F.col("name")
    own = named.withColumn("d", N.file_descriptor(name))
    return own.select("p_partkey", "d.standard_id", "d.code", "d.title", N.source_format(name).alias("source_format"), N.document_slug(name).alias("slug"))
