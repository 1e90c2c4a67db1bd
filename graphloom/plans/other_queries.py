"""Registered queries on payloads, evaluations, batches, embeddings, web tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph, graph_build, payloads
from graphloom.sources.stage import cut_lineage
from graphloom.sources.bindings import JOB_LOG, KG_EDGES, KG_NODES, duck, kg, tables
from graphloom.sources.stage import shared_dir
from graphloom.streaming import pipelines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, **ctes: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = duck(sql, **ctes) if ctes else sql
        return f

    return put


#: Drifted payloads from ``labels``: the container changes with doc_id.
DRIFTED = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('{"items":[{"clause_uid":"c', doc_id, '","requirements":[{"requirement_text":"r', quality, '"}]}]}')
 WHEN 1 THEN concat('{"results":[{"clause_id":"c', doc_id, '","requirements":[{"text":"r', quality, '"}]}]}') WHEN 2 THEN concat('{"clauses":[{"id":"c', doc_id, '"}]}')
 WHEN 3 THEN concat('{"data":{"items":[{"clause_uid":"c', doc_id, '"}]}}') WHEN 4 THEN concat('{"clause_uid":"c', doc_id, '","requirements":[{"requirement":"r', quality, '"}]}') ELSE concat('{"items":[c', doc_id) END AS payload FROM labels"""


def drifted(spark, sf) -> DataFrame:
    tables(spark, sf, "labels")
    return spark.sql(DRIFTED)


@query("extraction_payloads", "SELECT doc_id, 'c' || doc_id AS clause_uid, CASE WHEN doc_id % 6 IN (0, 1, 4) THEN 'r' || quality ELSE '' END AS texts FROM labels WHERE doc_id % 6 <> 5")
def extraction_payloads(spark, sf) -> DataFrame:
    return payloads.extraction_items(drifted(spark, sf), "doc_id").select("doc_id", "clause_uid", F.array_join("texts", ",").alias("texts"))


@query("quarantined_payloads", "SELECT doc_id FROM labels WHERE doc_id % 6 = 5")
def quarantined_payloads(spark, sf) -> DataFrame:
    return payloads.quarantined(drifted(spark, sf)).select("doc_id")


@query("title_payloads", "SELECT doc_id, 't' || doc_id AS title_id, CASE WHEN toxic = 1 THEN 'chapter' ELSE 'none' END AS label, CASE WHEN doc_id % 3 = 2 THEN 0.0 ELSE 0.5 END AS confidence FROM labels")
def title_payloads(spark, sf) -> DataFrame:
    tables(spark, sf, "labels")
    rows = spark.sql("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('{"titles":[{"id":"t', doc_id, '","type":"', IF(toxic = 1, 'Chapter', 'none'), '","score":0.5}]}')
      WHEN 1 THEN concat('[{"title_id":"t', doc_id, '","label":"', IF(toxic = 1, 'CHAPTER', 'none'), '","confidence":0.5}]') ELSE concat('{"labels":{"t', doc_id, '":"', IF(toxic = 1, 'chapter', 'none'), '"}}') END AS payload FROM labels""")
    return payloads.title_items(rows, "doc_id").drop("rationale")


@query("assessment_payloads", "SELECT doc_id, 'c' || doc_id AS clause_id, CASE WHEN quality = 1 THEN '符合' ELSE '缺失' END AS raw_status, 'why' AS reason, CASE WHEN doc_id % 2 = 0 THEN 'seen' END AS evidence FROM labels")
def assessment_payloads(spark, sf) -> DataFrame:
    tables(spark, sf, "labels")
    rows = spark.sql("""SELECT doc_id, IF(doc_id % 2 = 0, concat('{"assessments":[{"clauseId":"c', doc_id, '","status":"', IF(quality = 1, '符合', '缺失'), '","rationale":"why","quote":"seen"}]}'),
      concat('{"clause_results":[{"id":"c', doc_id, '","result":"', IF(quality = 1, '符合', '缺失'), '","reason":"why"}]}')) AS payload FROM labels""")
    return payloads.assessment_items(rows, "doc_id")


@query("title_confusion", "SELECT CAST(quality AS VARCHAR) AS baseline, CAST(toxic AS VARCHAR) AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def title_confusion(spark, sf) -> DataFrame:
    tables(spark, sf, "labels")
    return payloads.confusion(spark.sql("SELECT CAST(quality AS STRING) AS q, CAST(toxic AS STRING) AS t FROM labels"), "q", "t")


@query("title_agreement", "SELECT count(*) AS titles, count(*) FILTER (quality = toxic) AS equal, 0 AS upgraded FROM labels")
def title_agreement(spark, sf) -> DataFrame:
    tables(spark, sf, "labels")
    return payloads.agreement(spark.table("labels"), "quality", "toxic")


@query("output_modes", "SELECT CASE event_type WHEN 'error' THEN 'json' ELSE 'tool' END AS mode, count(*) AS attempts, count(*) FILTER (value >= 20) AS parsed, count(*) FILTER (value < 20) AS errors FROM events GROUP BY ALL")
def output_modes(spark, sf) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("mode", F.when(F.col("event_type") == "error", "json").otherwise("tool"))
    return rows.groupBy("mode").agg(F.count("*").alias("attempts"), F.count_if(F.col("value") >= 20).alias("parsed"), F.count_if(F.col("value") < 20).alias("errors"))


@query("attempt_metrics", """
SELECT user_id, count(*) AS requested, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (attempts > 1) AS retried, sum(attempts) AS attempts FROM
(SELECT user_id, event_type AS request, count(*) AS attempts, bool_or(value >= 90) AS ok FROM events GROUP BY ALL) GROUP BY ALL""")
def attempt_metrics(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return payloads.attempt_metrics(e.select("user_id", F.col("event_type").alias("request"), nth.alias("attempt"), (F.col("value") >= 90).alias("ok")), "user_id")


@query("turn_batches", "SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 6 AS batch FROM conversations")
def turn_batches(spark, sf) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", F.floor(nth / 6).alias("batch"))


@query("context_tails", """
SELECT conv_id, turn, role, coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ','), '') AS tail FROM conversations""")
def context_tails(spark, sf) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-4, -1)
    tail = F.array_join(F.collect_list(F.col("turn").cast("string")).over(w), ",")
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", tail.alias("tail"))


@query("embedding_store", "SELECT node_uid, 'concept' AS node_type, 'm' AS model, 64 AS dimensions FROM n JOIN embeddings ON split_part(node_uid, ':', 3) = CAST(vec_id AS VARCHAR) WHERE node_type = 'concept'", n=KG_NODES)
def embedding_store(spark, sf) -> DataFrame:
    nodes = cut_lineage(kg(spark, sf)[0].withColumn("embedding_text", F.col("label")))
    parts = nodes.where("node_type = 'concept'").select("node_uid", F.substring_index("node_uid", ":", -1).cast("long").alias("vec_id"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector")).join(parts, "vec_id").select("node_uid", "vector")
    return graph_build.embedding_store(graph_build.embedding_inputs(nodes), vectors, "m").select("node_uid", "node_type", "model", "dimensions")


@query("requirement_cards", """
SELECT standard_uid, source_uid AS node_uid, count(*) AS linked, string_agg(target_uid, ',' ORDER BY target_uid) FILTER (r <= 12) AS first FROM (SELECT *, row_number() OVER (PARTITION BY standard_uid, source_uid ORDER BY target_uid) AS r FROM e WHERE edge_type = 'DERIVES_REQUIREMENT') GROUP BY ALL""", e=KG_EDGES)
def requirement_cards(spark, sf) -> DataFrame:
    _, edges = kg(spark, sf)
    own = edges.where("edge_type = 'DERIVES_REQUIREMENT'").groupBy("standard_uid", F.col("source_uid").alias("node_uid")).agg(F.count("*").alias("linked"), F.array_sort(F.collect_list("target_uid")).alias("all"))
    return own.select("standard_uid", "node_uid", "linked", F.array_join(F.slice("all", 1, 12), ",").alias("first"))


@query("web_blocks", """
SELECT page_id, CASE tag WHEN 'h1' THEN 'title' WHEN 'li' THEN 'list_item' ELSE 'paragraph' END AS source_type, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|li|p)(?:>| [^>]*>)([^<]*)', 1)) AS tag FROM pages) GROUP BY ALL""")
def web_blocks(spark, sf) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    tags = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<(h1|li|p)(?:>| [^>]*>)([^<]*)"), F.lit(1))).alias("tag"))
    kind = F.when(F.col("tag") == "h1", "title").when(F.col("tag") == "li", "list_item").otherwise("paragraph")
    return tags.groupBy("page_id", kind.alias("source_type")).agg(F.count("*").alias("n"))


@query("stream_current_status", """
SELECT document_id, updated_at, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, job_id DESC) AS r FROM job_log) WHERE r = 1""", job_log=JOB_LOG)
def stream_current_status(spark, sf) -> DataFrame:
    at = f"{shared_dir(spark)}/graphloom-streams/{uuid.uuid4().hex}"
    events = pipelines.job_events(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema)
    run = pipelines.into_table(pipelines.current_status(events), f"{at}/table", f"{at}/checkpoint", ["document_id"], "update")
    return pipelines.run_to_end(run, lambda: pipelines.latest_version(spark, f"{at}/table"))


@query("stream_without_replays", "SELECT status, count(DISTINCT job_id) AS n FROM job_log GROUP BY ALL", job_log=JOB_LOG)
def stream_without_replays(spark, sf) -> DataFrame:
    at = f"{shared_dir(spark)}/graphloom-streams/{uuid.uuid4().hex}"
    events = pipelines.job_events(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema)
    twice = pipelines.without_replays(events.unionByName(events))
    run = pipelines.into_table(twice, f"{at}/table", f"{at}/checkpoint", ["job_id"])
    return pipelines.run_to_end(run, lambda: pipelines.latest_version(spark, f"{at}/table").groupBy("status").agg(F.count("*").alias("n")))
