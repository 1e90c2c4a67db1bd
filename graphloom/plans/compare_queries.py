"""Registered queries on comparisons, edits, jobs and documents, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.labels import natural_key
from graphloom.operators import compare, edits, graph, jobs
from graphloom.operators import merges as merges_
from graphloom.operators.ranks import group_ranks
from graphloom.plans.graph_queries import DEGREES, ENDS
from graphloom.sources.stage import cut_lineage
from graphloom.sources.bindings import ASSESSMENTS, CLAUSE_INFO, JOB_LOG, KG_EDGES, KG_NODES, assessments, clause_info, duck, job_log, kg, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ITEMS = """SELECT *, CASE raw_status WHEN 'Covered' THEN 'covered' WHEN '符合' THEN 'covered' WHEN 'partially covered' THEN 'partial' WHEN '缺失' THEN 'missing' WHEN 'violation' THEN 'violated' WHEN 'N/A' THEN 'not_applicable' ELSE raw_status END AS status FROM assessments"""
COVER = "CAST(coalesce(round(sum(CASE status WHEN 'covered' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END)::DOUBLE / nullif(count(*) FILTER (status <> 'not_applicable'), 0), 4), 0) AS DOUBLE)"
SUM = "'covered=' || count(*) FILTER (status = 'covered') || ', partial=' || count(*) FILTER (status = 'partial') || ', missing=' || count(*) FILTER (status = 'missing') || ', violated=' || count(*) FILTER (status = 'violated') || ', not_applicable=' || count(*) FILTER (status = 'not_applicable')"
CTES = {"assessments": ASSESSMENTS, "clause_info": CLAUSE_INFO, "items": ITEMS, "job_log": JOB_LOG, "n": KG_NODES, "e": KG_EDGES, "ends": ENDS, "d": DEGREES}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            used = {k: v for k, v in CTES.items()}
            ORACLE[name] = duck(sql, **used)
        return f

    return put


def items(spark, sf) -> DataFrame:
    return compare.with_status(assessments(spark, sf))


@query("status_normalization", "SELECT raw_status, status, count(*) AS n FROM items GROUP BY ALL")
def status_normalization(spark, sf) -> DataFrame:
    return items(spark, sf).groupBy("raw_status", "status").agg(F.count("*").alias("n"))


@query("unit_coverage", f"SELECT unit_uid, {COVER} AS coverage_score, {SUM} AS summary FROM items GROUP BY ALL")
def unit_coverage(spark, sf) -> DataFrame:
    return compare.unit_results(items(spark, sf))


@query("comparable_items", "SELECT unit_uid, clause_id, item_order FROM items WHERE status <> 'not_applicable'")
def comparable_items(spark, sf) -> DataFrame:
    return compare.comparable(items(spark, sf)).select("unit_uid", "clause_id", "item_order")


@query("item_details", "SELECT unit_uid, clause_id, item_order, status, clause_ref, section_id, chapter_id, label FROM items JOIN clause_info USING (clause_id)")
def item_details(spark, sf) -> DataFrame:
    return compare.item_details(items(spark, sf), clause_info(spark, sf)).select("unit_uid", "clause_id", "item_order", "status", "clause_ref", "section_id", "chapter_id", "label")


WORST = "CASE min(CASE status WHEN 'violated' THEN 0 WHEN 'covered' THEN 1 WHEN 'partial' THEN 2 WHEN 'missing' THEN 3 ELSE 4 END) WHEN 0 THEN 'violated' WHEN 1 THEN 'covered' WHEN 2 THEN 'partial' WHEN 3 THEN 'missing' ELSE 'not_applicable' END"


@query("clause_status", f"SELECT clause_id, clause_ref, any_value(label) AS label, {WORST} AS status FROM items JOIN clause_info USING (clause_id) GROUP BY clause_id, clause_ref")
def clause_status(spark, sf) -> DataFrame:
    return compare.clause_results(items(spark, sf), clause_info(spark, sf)).select("clause_id", "clause_ref", "label", "status")


@query("clause_reasons", """
SELECT clause_id, string_agg(reason, ' | ' ORDER BY f, reason) AS reason FROM (SELECT clause_id, reason, min({'u': unit_uid, 'o': item_order}) AS f FROM items GROUP BY ALL) GROUP BY ALL""")
def clause_reasons(spark, sf) -> DataFrame:
    return compare.clause_results(items(spark, sf), clause_info(spark, sf)).select("clause_id", "reason")


@query("report_coverage", f"""
SELECT section_id, {COVER} AS coverage_score, {SUM} AS summary FROM (SELECT clause_id, section_id, {WORST} AS status FROM items JOIN clause_info USING (clause_id) GROUP BY ALL) GROUP BY ALL""")
def report_coverage(spark, sf) -> DataFrame:
    per = compare.clause_results(items(spark, sf), clause_info(spark, sf))
    return per.groupBy("section_id").agg(compare.coverage(F.col("status")).alias("coverage_score"), compare.status_summary(F.col("status")).alias("summary"))


@query("matched_scopes", """
SELECT unit_uid, string_agg(DISTINCT section_id, ',' ORDER BY section_id) AS sections, string_agg(DISTINCT chapter_id, ',' ORDER BY chapter_id) AS chapters FROM items JOIN clause_info USING (clause_id) GROUP BY ALL""")
def matched_scopes(spark, sf) -> DataFrame:
    m = compare.matched_ids(items(spark, sf), clause_info(spark, sf))
    return m.select("unit_uid", F.array_join("sections", ",").alias("sections"), F.array_join("chapters", ",").alias("chapters"))


@query("candidate_clauses", """
SELECT unit_uid, c.section_id, count(*) AS n FROM (SELECT DISTINCT unit_uid, section_id FROM items JOIN clause_info USING (clause_id) WHERE item_order = 1) u JOIN clause_info c ON c.section_id = u.section_id GROUP BY ALL""")
def candidate_clauses(spark, sf) -> DataFrame:
    info = clause_info(spark, sf)
    chosen = items(spark, sf).where("item_order = 1").join(info, "clause_id").select("unit_uid", "section_id").distinct()
    return compare.chosen_counts(info, chosen)


@query("unit_routes", """
SELECT unit_uid, item_order, parent_uid, route FROM (SELECT unit_uid, item_order, 'scope' || (item_order % 5) AS parent_uid FROM items) JOIN (SELECT 'scope' || k AS parent_uid, 'route' || k AS route FROM range(4) t(k)) USING (parent_uid)""")
def unit_routes(spark, sf) -> DataFrame:
    units = items(spark, sf).select("unit_uid", "item_order", F.concat(F.lit("scope"), (F.col("item_order") % 5).cast("string")).alias("parent_uid"))
    scopes = units.select("parent_uid").distinct().where("parent_uid <> 'scope4'").withColumn("route", F.replace("parent_uid", F.lit("scope"), F.lit("route")))
    return compare.routed(units, scopes)[0].select("unit_uid", "item_order", "parent_uid", "route")


@query("natural_order", """
SELECT clause_id, row_number() OVER (ORDER BY list_transform(string_split(clause_ref, '.'), lambda x: lpad(x, 6, '0')), clause_id) AS position FROM clause_info""")
def natural_order(spark, sf) -> DataFrame:
    keyed = clause_info(spark, sf).withColumn("k", natural_key(F.col("clause_ref"), F.col("clause_id"))).repartitionByRange("k", "clause_id").sortWithinPartitions("k", "clause_id")
    # positions without one task for all: an offset per range
    parts = keyed.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id() % (1 << 33))
    parts = cut_lineage(parts)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    return parts.join(base, "part").select("clause_id", (F.col("base") + F.col("nth") + 1).alias("position"))


@query("hierarchy_sections", """
SELECT standard_uid, node_uid AS id, source_uid AS chapter_id, label, 'section' AS scope_type FROM n LEFT JOIN e USING (standard_uid) WHERE node_type = 'section' AND target_uid = node_uid
UNION ALL SELECT standard_uid, node_uid, node_uid, label, 'chapter_scope' FROM n WHERE node_type = 'chapter' AND node_uid NOT IN (SELECT source_uid FROM e WHERE target_uid LIKE 'supplier:%')""")
def hierarchy_sections(spark, sf) -> DataFrame:
    return compare.hierarchy(*kg(spark, sf))["sections"]


@query("hierarchy_clauses", """
SELECT n.standard_uid, node_uid AS id, source_uid AS section_id, source_uid AS chapter_id, label FROM n JOIN e ON e.target_uid = node_uid WHERE node_type = 'clause'""")
def hierarchy_clauses(spark, sf) -> DataFrame:
    return compare.hierarchy(*kg(spark, sf))["clauses"]


#: Values that name parts, exactly, at their beginning or within running text; of the ids that a value holds the first part's counts.
ID_VALUES = """SELECT concat('u', p_partkey) AS unit_uid, 1 AS position, CASE WHEN p_partkey % 4 = 3 THEN 'nothing known' WHEN p_partkey % 3 = 0 THEN concat('Part:', p_partkey, ' - ', p_name)
      WHEN p_partkey % 3 = 1 THEN concat('part:', p_partkey, ':x') ELSE concat(' PART:', p_partkey, ' ') END AS value FROM part"""
TEXT_VALUES = """SELECT concat('u', p_partkey) AS unit_uid, CAST(k AS INT) AS position, CASE WHEN k = 1 THEN 'no id' WHEN p_partkey % 2 = 0 THEN concat('参见Part:', p_partkey, '条与part:', 7 * p_partkey, '条')
      ELSE concat('[', p_brand, '/part:', 3 * p_partkey, '],', p_name) END AS value FROM part, (SELECT 1 AS k UNION ALL SELECT 2) t"""
#: The first part whose id a value holds, unless its own alias is all of it.
HELD = """SELECT unit_uid, position, arg_min(id, (tier, k)) AS id, min(tier) AS tier FROM (
  SELECT v.*, 'part:' || p_partkey AS id, p_partkey AS k, CAST(CASE WHEN lower(trim(value)) = 'part:' || p_partkey THEN 0 ELSE 1 END AS INTEGER) AS tier FROM v JOIN part ON contains(lower(value), 'part:' || p_partkey)) GROUP BY ALL"""
FIRST_HELD = "SELECT unit_uid, arg_min(id, position) AS id, arg_min(tier, position) AS tier FROM h GROUP BY ALL"


def resolved(spark, sf, values: str) -> DataFrame:
    tables(spark, sf, "part")
    known = spark.sql("SELECT concat('part:', p_partkey) AS id, concat('part:', p_partkey) AS alias, p_partkey AS alias_order FROM part")
    return compare.resolve_ids(spark.sql(values), known)


@query("resolved_ids", None)
def resolved_ids(spark, sf) -> DataFrame:
    return resolved(spark, sf, ID_VALUES)


@query("resolved_ids_in_text", None)
def resolved_ids_in_text(spark, sf) -> DataFrame:
    return resolved(spark, sf, TEXT_VALUES)


ORACLE["resolved_ids"] = duck(FIRST_HELD, v=ID_VALUES, h=HELD)
ORACLE["resolved_ids_in_text"] = duck(FIRST_HELD, v=TEXT_VALUES, h=HELD)


@query("comparison_graph_edges", """
SELECT standard_uid, edge_type, source_uid, target_uid FROM e WHERE edge_type = 'CONTAINS' AND (target_uid LIKE 'customer:%' OR target_uid IN (SELECT 'nation:' || c_nationkey FROM customer))
UNION ALL SELECT 'space' || n_regionkey, CASE c_custkey % 4 WHEN 0 THEN 'COVERED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'MISSING' ELSE 'VIOLATED' END, 'report-compare:u' || c_custkey % 3, 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def comparison_graph_edges(spark, sf) -> DataFrame:
    nodes, edges_ = kg(spark, sf)
    key = F.substring_index("node_uid", ":", -1).cast("long")
    status = F.element_at(F.array(*map(F.lit, ("covered", "partial", "missing", "violated"))), (key % 4 + 1).cast("int"))
    judged = nodes.where("node_type = 'clause'").select("standard_uid", F.concat(F.lit("u"), key % 3).alias("unit_uid"), "node_uid", status.alias("status"), F.lit("r").alias("reason"))
    return compare.comparison_graph(nodes, edges_, judged)[1]


@query("merge_entities", """
SELECT standard_uid, source_uid, target_uid, edge_type, min(edge_uid) AS edge_uid, count(DISTINCT edge_uid) - 1 AS folded FROM (SELECT standard_uid, edge_uid, edge_type, CASE source_uid WHEN 'nation:1' THEN 'nation:6' ELSE source_uid END AS source_uid, CASE target_uid WHEN 'nation:1' THEN 'nation:6' ELSE target_uid END AS target_uid FROM e)
WHERE source_uid <> target_uid GROUP BY ALL""")
def merge_entities(spark, sf) -> DataFrame:
    nodes, edges_ = kg(spark, sf)
    merges = nodes.where("node_uid = 'nation:1'").select("standard_uid", F.col("node_uid").alias("source"), F.lit("nation:6").alias("target"))
    return edits.merge_edges(edges_, merges).select("standard_uid", "source_uid", "target_uid", "edge_type", "edge_uid", F.size("merged_edge_ids").cast("long").alias("folded"))


@query("merge_entity_nodes", """
SELECT standard_uid, node_uid, CASE WHEN node_uid = 'nation:6' THEN 'Both' ELSE label END AS label, CASE WHEN node_uid = 'nation:6' THEN 'NATION_1,NATION_6' ELSE '' END AS aliases FROM n WHERE node_uid <> 'nation:1'""")
def merge_entity_nodes(spark, sf) -> DataFrame:
    nodes, _ = kg(spark, sf)
    merges = nodes.where("node_uid = 'nation:1'").select("standard_uid", F.col("node_uid").alias("source"), F.lit("nation:6").alias("target"))
    return edits.merge_nodes(nodes, merges, "Both").select("standard_uid", "node_uid", "label", F.coalesce(F.array_join("merged_aliases", ","), F.lit("")).alias("aliases"))


#: Clauses of a space in fours: the first goes into the second, that into the third with an edit, then the fourth into the third.
FOURS = """SELECT standard_uid, node_uid, label, node_type, k, (row_number() OVER (PARTITION BY standard_uid ORDER BY k) - 1) % 4 AS r, floor((row_number() OVER (PARTITION BY standard_uid ORDER BY k) - 1) / 4) AS g
  FROM (SELECT *, CAST(substr(node_uid, 10) AS BIGINT) AS k FROM n WHERE node_type = 'clause') t"""
FOUR_MERGES = """SELECT a.standard_uid, a.node_uid AS source, b.node_uid AS target, CASE a.r WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS seq, CASE WHEN a.r = 1 THEN 'group' END AS node_type
  FROM fours a JOIN fours b ON a.standard_uid = b.standard_uid AND a.g = b.g AND b.r = CASE a.r WHEN 0 THEN 1 ELSE 2 END WHERE a.r <> 2"""


def merged_fours(spark, sf) -> tuple[DataFrame, DataFrame]:
    nodes, edges_ = kg(spark, sf)
    nodes.createOrReplaceTempView("n")
    spark.sql(FOURS).createOrReplaceTempView("fours")
    merges = spark.sql(FOUR_MERGES).withColumn("seq", F.col("seq").cast("long"))
    merges = merges.withColumn("properties", F.when(F.col("seq") == 2, F.create_map(F.lit("k0"), F.lit("edited"), F.lit("by"), F.lit("2"))))
    k = F.substring_index("node_uid", ":", -1).cast("long")
    nodes = nodes.withColumn("properties", F.create_map(F.concat(F.lit("k"), k % 3), F.col("node_uid"))).withColumn("text_content", F.when(k % 5 == 0, F.concat(F.lit("text "), "label")))
    nodes = nodes.withColumn("node_type", F.when(k % 7 == 0, F.concat("node_type", F.lit("7"))).otherwise(F.col("node_type")))
    return merges_.merge_entities(nodes, edges_, merges)


@query("merged_chains", None)
def merged_chains(spark, sf) -> DataFrame:
    nodes = merged_fours(spark, sf)[0]
    lists = {c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("merged_aliases", "merged_node_ids")}
    return nodes.withColumns(lists | {"properties": graph.map_text("properties"), "text_content": F.coalesce("text_content", F.lit(""))})


@query("merged_chain_edges", None)
def merged_chain_edges(spark, sf) -> DataFrame:
    return merged_fours(spark, sf)[1].withColumn("merged_edge_ids", F.array_join("merged_edge_ids", ","))


#: p: 4 for the highest; the edit of the second merge stands over the first two.
FOUR_ITEMS = """SELECT standard_uid, g, node_uid, label, CASE WHEN k % 7 = 0 THEN node_type || '7' ELSE node_type END AS node_type, CASE WHEN k % 5 = 0 THEN 'text ' || label END AS text_content, CASE r WHEN 3 THEN 4.0 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS p, k, r,
  CASE WHEN max(r) OVER w >= 2 THEN 2 ELSE max(r) OVER w END AS root, max(r) OVER w AS top FROM fours WINDOW w AS (PARTITION BY standard_uid, g)"""
FOUR_ENTRIES = """SELECT standard_uid, g, 'k' || k % 3 AS name, node_uid AS v, p FROM i UNION ALL SELECT standard_uid, g, name, v, 3.0 FROM i, (VALUES ('k0', 'edited'), ('by', '2')) t(name, v) WHERE r = 2"""
FOUR_NODES = """SELECT i.standard_uid, max(CASE WHEN r = root THEN node_uid END) AS node_uid, coalesce(max(CASE WHEN p = 4 THEN node_type END), max(CASE WHEN top >= 2 THEN 'group' END), arg_max(node_type, p)) AS node_type, arg_max(label, p) AS label,
  coalesce(arg_max(text_content, p) FILTER (text_content IS NOT NULL), '') AS text_content, max(props) AS properties, CASE WHEN count(*) = 1 THEN '' ELSE coalesce(string_agg(label, ',' ORDER BY label) FILTER (label <> lab), '') END AS merged_aliases, CASE WHEN count(*) = 1 THEN '' ELSE string_agg(node_uid, ',' ORDER BY node_uid) END AS merged_node_ids
  FROM i JOIN (SELECT standard_uid, g, string_agg(name || '=' || v, ',' ORDER BY name) AS props FROM (SELECT standard_uid, g, name, arg_max(v, p) AS v FROM ent GROUP BY ALL) GROUP BY ALL) USING (standard_uid, g)
  JOIN (SELECT standard_uid, g, arg_max(label, p) AS lab FROM i GROUP BY ALL) USING (standard_uid, g) GROUP BY i.standard_uid, g"""
OTHER_NODES = """SELECT standard_uid, node_uid, CASE WHEN k % 7 = 0 THEN node_type || '7' ELSE node_type END AS node_type, label, CASE WHEN k % 5 = 0 THEN 'text ' || label ELSE '' END AS text_content, 'k' || k % 3 || '=' || node_uid AS properties, '' AS merged_aliases, '' AS merged_node_ids
  FROM (SELECT *, CAST(string_split(node_uid, ':')[-1] AS BIGINT) AS k FROM n WHERE node_type <> 'clause')"""
SURVIVORS = "SELECT i.standard_uid, i.node_uid, s.node_uid AS survivor FROM i JOIN i s ON i.standard_uid = s.standard_uid AND i.g = s.g AND s.r = s.root"
ORACLE["merged_chains"] = duck(f"SELECT * FROM ({FOUR_NODES}) UNION ALL SELECT * FROM ({OTHER_NODES})", n=KG_NODES, fours=FOURS, i=FOUR_ITEMS, ent=FOUR_ENTRIES)
ORACLE["merged_chain_edges"] = duck("""SELECT standard_uid, min(edge_uid) AS edge_uid, edge_type, source_uid, target_uid, coalesce(string_agg(DISTINCT edge_uid, ',' ORDER BY edge_uid) FILTER (edge_uid <> least_uid), '') AS merged_edge_ids FROM (
  SELECT *, min(edge_uid) OVER (PARTITION BY standard_uid, source_uid, target_uid, edge_type) AS least_uid FROM (
  SELECT e.standard_uid, edge_uid, edge_type, coalesce(a.survivor, source_uid) AS source_uid, coalesce(b.survivor, target_uid) AS target_uid FROM e LEFT JOIN s a ON a.standard_uid = e.standard_uid AND a.node_uid = source_uid LEFT JOIN s b ON b.standard_uid = e.standard_uid AND b.node_uid = target_uid)
  WHERE source_uid <> target_uid) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY standard_uid, edge_type, source_uid, target_uid"), n=KG_NODES, e=KG_EDGES, fours=FOURS, i=FOUR_ITEMS, s=SURVIVORS)  # fmt: skip


@query("serialized_edges", "SELECT standard_uid, edge_uid AS id, source_uid AS source, target_uid AS target, edge_type, 'edge_uid=' || edge_uid AS properties FROM e")
def serialized_edges(spark, sf) -> DataFrame:
    return edits.serialized_edges(kg(spark, sf)[1]).withColumn("properties", graph.map_text("properties"))


@query("edited_relations", """
SELECT standard_uid, edge_uid, CASE WHEN source_uid LIKE 'region:%' THEN 'HAS' ELSE edge_type END AS edge_type, CASE WHEN source_uid LIKE 'region:%' THEN 'a=new,b=1,note=' || target_uid ELSE 'a=old' END AS properties FROM e""")
def edited_relations(spark, sf) -> DataFrame:
    edges_ = kg(spark, sf)[1].withColumn("properties", F.create_map(F.lit("a"), F.lit("old")))
    fields = F.create_map(F.lit("relation_type"), F.lit(" HAS "), F.lit("note"), F.col("target_uid"), F.lit("a"), F.lit("new"))
    changes = edges_.where("source_uid LIKE 'region:%'").select("standard_uid", "edge_uid", fields.alias("fields"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("explicit")).alias("properties"))
    return merges_.edit_relations(edges_, changes).select("standard_uid", "edge_uid", "edge_type", graph.map_text("properties").alias("properties"))


@query("edited_entities", """
SELECT standard_uid, node_uid, CASE WHEN node_type = 'chapter' THEN 'New ' || label ELSE label END AS label, CASE WHEN node_type = 'chapter' THEN 'topic' ELSE node_type END AS node_type, CASE WHEN node_type = 'chapter' THEN 'about ' || label ELSE '' END AS text_content,
  CASE WHEN node_type = 'chapter' THEN 'size=3' ELSE '' END AS properties FROM n""")
def edited_entities(spark, sf) -> DataFrame:
    nodes, _ = kg(spark, sf)
    fields = F.create_map(F.lit("entity_name"), F.concat(F.lit(" New "), "label"), F.lit("entity_type"), F.lit("topic"), F.lit("description"), F.concat(F.lit("about "), "label"), F.lit("size"), F.lit("3"), F.lit("label"), F.lit(" "))
    changes = nodes.where("node_type = 'chapter'").select("standard_uid", "node_uid", fields.alias("fields"))
    out = merges_.edit_entities(nodes, changes)
    return out.select("standard_uid", "node_uid", "label", "node_type", F.coalesce("text_content", F.lit("")).alias("text_content"), graph.map_text("properties").alias("properties"))


@query("patched_nodes", "SELECT standard_uid, node_uid, CASE WHEN node_type = 'chapter' THEN 'new ' || label ELSE label END AS label, node_type FROM n")
def patched_nodes(spark, sf) -> DataFrame:
    nodes, _ = kg(spark, sf)
    changes = nodes.where("node_type = 'chapter'").select("standard_uid", "node_uid", F.create_map(F.lit("label"), F.concat(F.lit("new "), "label")).alias("fields"))
    return edits.patch(nodes, changes, ["standard_uid", "node_uid"], ["label", "node_type"]).select("standard_uid", "node_uid", "label", "node_type")


@query("patched_edges", "SELECT standard_uid, edge_uid, CASE WHEN source_uid LIKE 'region:%' THEN 'HAS' ELSE edge_type END AS edge_type FROM e")
def patched_edges(spark, sf) -> DataFrame:
    _, edges_ = kg(spark, sf)
    changes = edges_.where("source_uid LIKE 'region:%'").select("standard_uid", "edge_uid", F.create_map(F.lit("edge_type"), F.lit("HAS")).alias("fields"))
    return edits.patch(edges_, changes, ["standard_uid", "edge_uid"], ["edge_type", "source_uid", "target_uid"]).select("standard_uid", "edge_uid", "edge_type")


@query("dangling_edge_changes", "SELECT standard_uid, edge_uid, 'nation:999' AS node_uid FROM e WHERE source_uid LIKE 'region:%'")
def dangling_edge_changes(spark, sf) -> DataFrame:
    nodes, edges_ = kg(spark, sf)
    changes = edges_.where("source_uid LIKE 'region:%'").select("standard_uid", "edge_uid", F.create_map(F.lit("target_uid"), F.lit("nation:999"), F.lit("source_uid"), F.col("source_uid")).alias("fields"))
    return edits.dangling_ends(nodes, changes).select("standard_uid", "edge_uid", "node_uid")


@query("entity_edit_outcome", """
SELECT standard_uid, node_uid, (SELECT min(node_uid) FROM n m WHERE m.standard_uid = n.standard_uid AND m.label = 'NATION_6') AS twin, true AS renamed,
 CASE WHEN EXISTS (SELECT 1 FROM n m WHERE m.standard_uid = n.standard_uid AND m.label = 'NATION_6') THEN 'merge' ELSE 'update' END AS outcome FROM n WHERE node_uid = 'nation:1' OR node_uid = 'nation:2'""")
def entity_edit_outcome(spark, sf) -> DataFrame:
    nodes, _ = kg(spark, sf)
    one = edits.find_entity(nodes, "nation:1", None).unionByName(edits.find_entity(nodes, None, " Nation_2"))
    return edits.edit_check(nodes, one, "nation_6", allow_rename=True, allow_merge=True)


@query("found_relation", "SELECT standard_uid, min(edge_uid) AS edge_uid FROM e WHERE source_uid = 'region:1' AND target_uid = 'nation:1' GROUP BY ALL")
def found_relation(spark, sf) -> DataFrame:
    return edits.find_relation(kg(spark, sf)[1], None, "region:1", "nation:1").select("standard_uid", "edge_uid")


@query("upserted_nodes", """
SELECT standard_uid, node_uid, CASE WHEN node_type = 'chapter' THEN upper(label) || '!' ELSE label END AS label, CASE WHEN node_type = 'chapter' THEN 1.0 ELSE 0.0 END AS weight FROM n WHERE node_type IN ('standard', 'chapter', 'section')""")
def upserted_nodes(spark, sf) -> DataFrame:
    nodes = kg(spark, sf)[0].where("node_type IN ('standard', 'chapter', 'section')").select("standard_uid", "node_uid", "node_type", "label")
    old = nodes.where("node_type <> 'section'").select("standard_uid", "node_uid", "label", F.when(F.col("node_type") == "chapter", 1.0).otherwise(0.0).alias("weight"))
    new = nodes.where("node_type = 'chapter'").select("standard_uid", "node_uid", F.concat(F.upper("label"), F.lit("!")).alias("label"), F.lit(None).cast("double").alias("weight"))
    new = new.unionByName(nodes.where("node_type = 'section'").select("standard_uid", "node_uid", "label", F.lit(0.0).alias("weight")))
    return edits.upsert(old, new, ["standard_uid", "node_uid"], keep_old_if_null=["weight"])


@query("merged_subgraphs", """
SELECT standard_uid, node_uid, label, node_type IN ('standard', 'chapter') AS was_known FROM n WHERE node_type IN ('standard', 'chapter', 'section')""")
def merged_subgraphs(spark, sf) -> DataFrame:
    nodes = kg(spark, sf)[0].select("standard_uid", "node_uid", "node_type", "label")
    current, incoming = nodes.where("node_type IN ('standard', 'chapter')"), nodes.where("node_type IN ('chapter', 'section')")
    return edits.merge_graphs(current, incoming, ["standard_uid", "node_uid"]).select("standard_uid", "node_uid", "label", "was_known")


@query("serialized_nodes", "SELECT standard_uid, node_uid AS id, label, node_type, 'node_uid=' || node_uid || ',standard_uid=' || standard_uid AS properties FROM n")
def serialized_nodes(spark, sf) -> DataFrame:
    s = edits.serialized(kg(spark, sf)[0])
    return s.withColumn("properties", graph.map_text("properties"))


@query("registry_upsert", """
SELECT 'nation' || n_nationkey AS standard_id, CASE WHEN n_nationkey < 15 THEN n_name ELSE 'new ' || n_name END AS title, CASE WHEN n_nationkey < 10 THEN 'a' WHEN n_nationkey < 15 THEN 'a,b' ELSE 'b' END AS aliases FROM nation""")
def registry_upsert(spark, sf) -> DataFrame:
    tables(spark, sf, "nation")
    rows = spark.sql("SELECT concat('nation', n_nationkey) AS standard_id, n_name AS title, n_nationkey AS k FROM nation")
    old = rows.where("k < 15").select("standard_id", "title", F.array(F.lit("a")).alias("aliases"))
    new = rows.where("k >= 10").select("standard_id", F.concat(F.lit("new "), "title").alias("title"), F.array(F.lit("b")).alias("aliases"))
    return edits.registry_upsert(old, new).withColumn("aliases", F.array_join("aliases", ","))


@query("deleted_document", "SELECT 'nodes' AS part, count(*) AS n FROM n WHERE standard_uid <> 'space1' UNION ALL SELECT 'edges', count(*) FROM e WHERE standard_uid <> 'space1' UNION ALL SELECT 'jobs', count(*) FROM job_log WHERE document_id <> 'doc1'")
def deleted_document(spark, sf) -> DataFrame:
    nodes, edges_ = kg(spark, sf)
    registry = nodes.select("standard_uid").distinct().withColumn("document_id", F.replace("standard_uid", F.lit("space"), F.lit("doc")))
    left = edits.delete_document("doc1", job_log(spark, sf), registry, nodes, edges_)
    parts = [left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k in ("nodes", "edges", "jobs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("latest_jobs", """
SELECT document_id, updated_at, job_id, status, progress FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, job_id DESC) AS r FROM job_log) WHERE r = 1""")
def latest_jobs(spark, sf) -> DataFrame:
    return jobs.latest(job_log(spark, sf))


@query("document_jobs", "SELECT job_id, status, updated_at FROM job_log WHERE document_id = 'doc7'")
def document_jobs(spark, sf) -> DataFrame:
    return jobs.newest_first(job_log(spark, sf).where("document_id = 'doc7'"), "updated_at", "job_id").select("job_id", "status", "updated_at")


@query("status_buckets", """
SELECT CASE WHEN status IN ('ready', 'succeeded') THEN 'completed' WHEN status = 'failed' THEN 'failed' ELSE 'processing' END AS bucket, count(*) AS n FROM job_log GROUP BY ALL""")
def status_buckets(spark, sf) -> DataFrame:
    return jobs.bucket_counts(job_log(spark, sf))


@query("matching_jobs", "SELECT job_id, document_id, status FROM job_log WHERE status = 'failed' AND contains(lower(document_id || ' ' || CAST(job_id AS VARCHAR)), '12')")
def matching_jobs(spark, sf) -> DataFrame:
    return jobs.matching(job_log(spark, sf), "failed", " 12 ", "document_id", "job_id").select("job_id", "document_id", "status")


@query("job_page", "SELECT job_id FROM job_log ORDER BY updated_at DESC, job_id LIMIT 20 OFFSET 40")
def job_page(spark, sf) -> DataFrame:
    return jobs.page(job_log(spark, sf), 3, 20, F.desc("updated_at"), "job_id").select("job_id")


@query("document_listing", """
WITH l AS (SELECT document_id, job_id, status, progress FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, job_id DESC) AS r FROM job_log) WHERE r = 1),
g AS (SELECT 'doc' || r_regionkey AS document_id, 'space' || r_regionkey AS standard_uid, CASE WHEN r_regionkey % 2 = 0 THEN 'ready' END AS graph_status FROM region),
t AS (SELECT standard_uid, count(*) AS nodes FROM n GROUP BY ALL), u AS (SELECT standard_uid, count(*) AS edges FROM e GROUP BY ALL)
SELECT document_id, standard_uid, coalesce(graph_status, status, 'unknown') AS status, progress, job_id AS latest_job_id, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM g FULL JOIN l USING (document_id) LEFT JOIN t USING (standard_uid) LEFT JOIN u USING (standard_uid)""")
def document_listing(spark, sf) -> DataFrame:
    nodes, edges_ = kg(spark, sf)
    tables(spark, sf, "region")
    registry = spark.sql("SELECT concat('doc', r_regionkey) AS document_id, concat('space', r_regionkey) AS standard_uid, CASE WHEN r_regionkey % 2 = 0 THEN 'ready' END AS graph_status FROM region")
    return jobs.document_listing(job_log(spark, sf), registry, graph.space_stats(nodes, edges_).select("standard_uid", "nodes", "edges"))


#: A unit in three per space, which every third customer's clause is compared with; some suppliers are matched sections.
UNIT_ITEMS = """SELECT standard_uid, 'doc1' AS document_id, 'u' || k % 3 AS unit_uid, row_number() OVER (PARTITION BY standard_uid, k % 3 ORDER BY k) AS position, node_uid,
  CASE k % 5 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' WHEN 2 THEN 'missing' WHEN 3 THEN 'violated' ELSE 'not_applicable' END AS status, 'reason ' || k AS reason, CASE WHEN k % 2 = 0 THEN 'evidence ' || label END AS evidence
  FROM (SELECT *, CAST(string_split(node_uid, ':')[-1] AS BIGINT) AS k FROM n WHERE node_type = 'clause') t"""
UNIT_HELD = """SELECT DISTINCT unit_uid, standard_uid, node_uid FROM items WHERE status <> 'not_applicable' UNION SELECT unit_uid, i.standard_uid, e.source_uid FROM items i JOIN e ON e.standard_uid = i.standard_uid AND e.target_uid = i.node_uid AND edge_type = 'CONTAINS' WHERE status <> 'not_applicable'
  UNION SELECT unit_uid, i.standard_uid, f.source_uid FROM items i JOIN e ON e.standard_uid = i.standard_uid AND e.target_uid = i.node_uid AND e.edge_type = 'CONTAINS' JOIN e f ON f.standard_uid = i.standard_uid AND f.target_uid = e.source_uid AND f.edge_type = 'CONTAINS' WHERE status <> 'not_applicable'
  UNION SELECT 'u' || CAST(string_split(node_uid, ':')[-1] AS BIGINT) % 3, standard_uid, node_uid FROM n WHERE node_type = 'section'"""


def unit_graphs(spark, sf) -> tuple[DataFrame, DataFrame]:
    nodes, edges_ = kg(spark, sf)
    k = F.substring_index("node_uid", ":", -1).cast("long")
    unit = F.concat(F.lit("u"), k % 3).alias("unit_uid")
    status = F.element_at(F.array(*map(F.lit, ("covered", "partial", "missing", "violated", "not_applicable"))), (k % 5 + 1).cast("int"))
    items = nodes.where("node_type = 'clause'").select("standard_uid", F.lit("doc1").alias("document_id"), unit, k.alias("k"), "node_uid", status.alias("status"), F.concat(F.lit("reason "), k).alias("reason"), F.when(k % 2 == 0, F.concat(F.lit("evidence "), "label")).alias("evidence"))
    items = group_ranks(items, ["standard_uid", "unit_uid"], ["k"], "position").drop("k")
    units = spark.range(3).select(F.lit("doc1").alias("document_id"), F.concat(F.lit("u"), "id").alias("unit_uid"), F.concat(F.lit("text "), "id").alias("text"), F.array(F.lit("1"), F.lit("1.1")).alias("section_path"))
    matched = nodes.where("node_type = 'section'").select("standard_uid", F.lit("doc1").alias("document_id"), unit, "node_uid")
    return compare.unit_graphs(nodes, edges_, items, units, matched)


@query("comparison_unit_nodes", None)
def comparison_unit_nodes(spark, sf) -> DataFrame:
    return unit_graphs(spark, sf)[0].withColumn("properties", graph.map_text("properties"))


@query("comparison_unit_edges", None)
def comparison_unit_edges(spark, sf) -> DataFrame:
    return unit_graphs(spark, sf)[1].withColumn("properties", graph.map_text("properties"))


UNIT_CTES = {"n": KG_NODES, "e": KG_EDGES, "items": UNIT_ITEMS, "held": UNIT_HELD}
ORACLE["comparison_unit_nodes"] = duck("""
SELECT 'doc1' AS document_id, unit_uid, h.standard_uid, node_uid AS id, label, node_type, 'node_uid=' || node_uid || ',standard_uid=' || h.standard_uid AS properties, (SELECT count(*) FROM e WHERE e.standard_uid = h.standard_uid AND source_uid = node_uid) + (SELECT count(*) FROM e WHERE e.standard_uid = h.standard_uid AND target_uid = node_uid) AS degree
FROM held h JOIN n USING (standard_uid, node_uid) UNION ALL SELECT 'doc1', unit_uid, standard_uid, 'report-compare:doc1:' || unit_uid, 'Report Unit', 'report_unit', 'document_id=doc1,section_path=["1","1.1"],text_content=text ' || substr(unit_uid, 2) || ',unit_uid=' || unit_uid, 0 FROM (SELECT DISTINCT unit_uid, standard_uid FROM items UNION SELECT unit_uid, standard_uid FROM held)""", **UNIT_CTES)  # fmt: skip
ORACLE["comparison_unit_edges"] = duck("""
SELECT 'doc1' AS document_id, a.unit_uid, e.standard_uid, edge_uid AS id, source_uid AS source, target_uid AS target, edge_type, 'edge_uid=' || edge_uid AS properties FROM e JOIN held a ON a.standard_uid = e.standard_uid AND a.node_uid = target_uid JOIN held b ON b.standard_uid = e.standard_uid AND b.node_uid = source_uid AND b.unit_uid = a.unit_uid WHERE edge_type = 'CONTAINS'
UNION ALL SELECT 'doc1', unit_uid, standard_uid, 'report-compare-edge:' || position, 'report-compare:doc1:' || unit_uid, node_uid, upper(status), 'reason=' || reason || coalesce(',report_evidence=' || evidence, '') FROM items WHERE status <> 'not_applicable'""", **UNIT_CTES)  # fmt: skip


@query("unit_scores", f"""
SELECT unit_uid, CASE WHEN m <> 0 THEN greatest(0.0, least(1.0, m)) ELSE coverage_score END AS coverage_score FROM (
 SELECT unit_uid, CASE CAST(substr(unit_uid, 5) AS BIGINT) % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 7.0 WHEN 2 THEN 0.0 END AS m, {COVER} AS coverage_score FROM items GROUP BY unit_uid)""")
def unit_scores(spark, sf) -> DataFrame:
    rows = items(spark, sf)
    k = F.substring("unit_uid", 5, 19).cast("long") % 4
    given = rows.select("unit_uid").distinct().withColumn("model_score", F.when(k == 0, "0.5").when(k == 1, "7").when(k == 2, "0").otherwise("none"))
    return compare.resolved_unit_scores(given, rows).select("unit_uid", "coverage_score")
