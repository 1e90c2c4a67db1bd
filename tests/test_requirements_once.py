"""What requirements of a list share is worked out a clause, and their edges and nodes come of one pass over them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.functions import normative as N
from graphloom.operators import graph_build

SF = Path("/root/testdata/sf0.001")


def test_requirement_under_its_intro(spark):
    intros = ["1.1.1 大坝应包括下列内容：", "宜包括以下：", "检测应遵守下列规定：", "1 说明如下：", "", None]
    rows = spark.createDataFrame([(i, t) for i in intros for t in ("资料；", "1）记录。", "")], "intro string, item string")
    once = rows.withColumn("shared", N.item_intro(F.col("intro"))).select(N.requirement_under(F.col("shared"), F.col("item")).alias("a"), N.item_requirement(F.col("intro"), F.col("item")).alias("b")).collect()
    assert all(r.a == r.b for r in once) and once[0].a == "大坝应包括资料。" and once[6].a == "检测应遵守：资料。"


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("build", [graph_build.standard_edges, graph_build.standard_nodes])
def test_one_pass_over_requirements(spark, build):
    from graphloom.plans import standard_queries

    plan = build(*standard_queries.parts(spark, str(SF)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
