"""Inputs of the registered queries, derived from the driver's tables.

The SQL below is the same text in Spark and DuckDB, so that a query and its SQL form start from
equal rows.  ``tables`` registers the driver's tables of one folder as views for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations benchmark".split()

#: One standard per nation: chapters, sections and clauses from customers, list items from orders.
SPEC_BLOCKS = """
WITH c AS (
  SELECT c_custkey, c_name, c_mktsegment, c_nationkey,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer),
k AS (
  SELECT *, CAST(floor(n / 12) AS INT) + 1 AS ch, CAST(floor((n % 12) / 4) AS INT) + 1 AS sec,
         CAST(n % 4 AS INT) + 1 AS cl, CAST(n AS INT) + 1 AS page_idx FROM c),
o AS (
  SELECT o_custkey, o_orderkey, o_orderpriority,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS item_idx FROM orders),
b AS (
  SELECT c_nationkey, page_idx, 1 AS block_idx, 0 AS item_idx, 'title' AS source_type,
         concat(CAST(ch AS VARCHAR(9)), ' ', c_mktsegment) AS text FROM k WHERE n % 12 = 0
  UNION ALL
  SELECT c_nationkey, page_idx, 2, 0, 'title', concat(CAST(ch AS VARCHAR(9)), '.', CAST(sec AS VARCHAR(9)), ' 节') FROM k WHERE n % 4 = 0
  UNION ALL
  SELECT c_nationkey, page_idx, 3, 0, 'paragraph',
         concat(CAST(ch AS VARCHAR(9)), '.', CAST(sec AS VARCHAR(9)), '.', CAST(cl AS VARCHAR(9)), ' ', c_name, '应包括下列内容：') FROM k
  UNION ALL
  SELECT c_nationkey, page_idx, 4, 0, 'title', concat(CAST(ch + 1 AS VARCHAR(9)), ' 规定如下：') FROM k WHERE c_custkey % 7 = 0
  UNION ALL
  SELECT c_nationkey, page_idx, 5, item_idx, 'list_item',
         concat(CAST(item_idx AS VARCHAR(9)), '）监测资料',
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '必须' WHEN '2' THEN '应' WHEN '3' THEN '宜' WHEN '4' THEN '可' ELSE '不得' END,
           '符合 GB ', CAST(50000 + o_orderkey % 300 AS VARCHAR(9)), '-2016；') FROM k JOIN o ON o_custkey = c_custkey
  UNION ALL
  SELECT c_nationkey, page_idx, 6, 0, 'table', concat('表 ', CAST(ch AS VARCHAR(9)), '.', CAST(sec AS VARCHAR(9)), '-', CAST(cl AS VARCHAR(9)), ' 特性表') FROM k WHERE c_custkey % 5 = 0)
SELECT concat('sn', CAST(c_nationkey AS VARCHAR(9)), ':2024') AS standard_uid, page_idx, block_idx, item_idx, source_type, text FROM b
"""

#: One report per document, from numbered lines ``doc_lines``.
DOC_BLOCKS = """
SELECT concat('doc', CAST(doc_id AS VARCHAR(19))) AS document_id, CAST(floor((line_no - 1) / 40) AS INT) + 1 AS page_idx,
       CAST(line_no AS INT) AS block_idx,
       CASE WHEN line_no = 1 OR length(line) < 30 THEN 'title' WHEN line_no % 7 = 0 THEN 'list_item' ELSE 'paragraph' END AS source_type,
       line AS text
FROM doc_lines WHERE length(trim(line)) > 0
"""

#: A graph space per region: nodes.
KG_NODES = """
WITH cr AS (SELECT c_custkey, c_name, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
ok AS (SELECT o_orderkey, o_custkey, o_orderpriority, n_regionkey FROM orders JOIN cr ON o_custkey = c_custkey),
pa AS (SELECT DISTINCT n_regionkey, l_partkey FROM lineitem JOIN ok ON l_orderkey = o_orderkey)
SELECT concat('space', CAST(r_regionkey AS VARCHAR(9))) AS standard_uid, concat('region:', CAST(r_regionkey AS VARCHAR(9))) AS node_uid, 'standard' AS node_type, r_name AS label FROM region
UNION ALL SELECT concat('space', CAST(n_regionkey AS VARCHAR(9))), concat('nation:', CAST(n_nationkey AS VARCHAR(9))), 'chapter', n_name FROM nation
UNION ALL SELECT concat('space', CAST(n_regionkey AS VARCHAR(9))), concat('supplier:', CAST(s_suppkey AS VARCHAR(19))), 'section', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('space', CAST(n_regionkey AS VARCHAR(9))), concat('customer:', CAST(c_custkey AS VARCHAR(19))), 'clause', c_name FROM cr
UNION ALL SELECT concat('space', CAST(n_regionkey AS VARCHAR(9))), concat('order:', CAST(o_orderkey AS VARCHAR(19))), 'requirement', concat('Order ', o_orderpriority) FROM ok
UNION ALL SELECT concat('space', CAST(n_regionkey AS VARCHAR(9))), concat('part:', CAST(n_regionkey AS VARCHAR(9)), ':', CAST(l_partkey AS VARCHAR(19))), 'concept', p_name FROM pa JOIN part ON l_partkey = p_partkey
"""

#: A graph space per region: edges.
KG_EDGES = """
WITH cr AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
ok AS (SELECT o_orderkey, o_custkey, n_regionkey FROM orders JOIN cr ON o_custkey = c_custkey),
e AS (
  SELECT n_regionkey AS r, 'CONTAINS' AS edge_type, concat('region:', CAST(n_regionkey AS VARCHAR(9))) AS source_uid, concat('nation:', CAST(n_nationkey AS VARCHAR(9))) AS target_uid FROM nation
  UNION ALL SELECT n_regionkey, 'CONTAINS', concat('nation:', CAST(n_nationkey AS VARCHAR(9))), concat('supplier:', CAST(s_suppkey AS VARCHAR(19))) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'CONTAINS', concat('nation:', CAST(c_nationkey AS VARCHAR(9))), concat('customer:', CAST(c_custkey AS VARCHAR(19))) FROM cr
  UNION ALL SELECT n_regionkey, 'DERIVES_REQUIREMENT', concat('customer:', CAST(o_custkey AS VARCHAR(19))), concat('order:', CAST(o_orderkey AS VARCHAR(19))) FROM ok
  UNION ALL SELECT DISTINCT n_regionkey, 'ABOUT', concat('order:', CAST(o_orderkey AS VARCHAR(19))), concat('part:', CAST(n_regionkey AS VARCHAR(9)), ':', CAST(l_partkey AS VARCHAR(19))) FROM lineitem JOIN ok ON l_orderkey = o_orderkey)
SELECT concat('space', CAST(r AS VARCHAR(9))) AS standard_uid,
       concat('edge:', substr(sha1(concat(edge_type, '|', source_uid, '|', target_uid)), 1, 16)) AS edge_uid, edge_type, source_uid, target_uid FROM e
"""

#: Events as job progress.
JOB_LOG = """
SELECT event_id AS job_id, concat('doc', CAST(user_id AS VARCHAR(19))) AS document_id,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
       least(value / 100, 1.0) AS progress, ts AS updated_at FROM events
"""

#: Line items as comparison results.
ASSESSMENTS = """
SELECT concat('unit', CAST(l_orderkey AS VARCHAR(19))) AS unit_uid, concat('part:', CAST(l_partkey AS VARCHAR(19))) AS clause_id,
       CASE CAST((l_orderkey + l_linenumber) % 7 AS INT) WHEN 0 THEN 'Covered' WHEN 1 THEN '符合' WHEN 2 THEN 'partially covered' WHEN 3 THEN '缺失'
            WHEN 4 THEN 'violation' WHEN 5 THEN 'N/A' ELSE 'unclear' END AS raw_status,
       concat('reason ', l_returnflag, l_linestatus) AS reason, CAST(l_linenumber AS INT) AS item_order FROM lineitem
"""

#: Parts as clauses.
CLAUSE_INFO = """
SELECT concat('part:', CAST(p_partkey AS VARCHAR(19))) AS clause_id, concat('1.', CAST(p_size AS VARCHAR(9)), '.', CAST(p_partkey AS VARCHAR(19))) AS clause_ref,
       p_brand AS section_id, p_type AS chapter_id, p_name AS label FROM part
"""

#: DuckDB's form of the only engine-specific part: the numbered lines of the documents.
DUCK_LINES = "SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names or NAMES:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables(spark, sf_dir, *[n for n in NAMES if f" {n} " in f" {sql} ".replace("\n", " ").replace(",", " ").replace(")", " ")])
    return spark.sql(sql)


def spec_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, SPEC_BLOCKS)


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select("doc_id", F.posexplode(F.split("text", "\n"))).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line")).createOrReplaceTempView("doc_lines")
    return spark.sql(DOC_BLOCKS)


def kg(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); nodes have no text or properties of their own here, so both are null."""
    nodes = bound(spark, sf_dir, KG_NODES).withColumn("text_content", F.lit(None).cast("string"))
    return nodes, bound(spark, sf_dir, KG_EDGES)


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, JOB_LOG)


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, ASSESSMENTS)


def clause_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, CLAUSE_INFO)


def duck(query: str, **ctes: str) -> str:
    """``query`` after the given common table expressions."""
    query = query.strip()
    more = query.startswith("WITH ")  # the query brings expressions of its own
    return "WITH " + ",\n".join(f"{n} AS ({s.strip()})" for n, s in ctes.items()) + (",\n" if more else "\n") + query[5 * more :]
