"""Rows of a small file are dealt over many tasks before they become many large ones."""

from pyspark.sql import functions as F

from lorespark.operators import facts, ingest
from lorespark.terms import TRIPLE, graph_union


def test_a_large_graph_is_dealt_before_equal_triples_are_sought(spark):
    rows = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("s"), F.col("id") % 1000).alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.lit("iri").alias("o_kind"), *[F.lit(None).cast("string").alias(c) for c in ("o_dt", "o_lang")])
    g = graph_union(rows, rows, dealt=True)
    plan = g._sc._jvm.PythonSQLUtils.explainString(g._jdf.queryExecution(), "simple")
    assert plan.index("Exchange") > plan.rindex("HashAggregate")  # no task that reads the one file counts triples
    held = g.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 2 and sum(r["count"] for r in held) == 1000


def test_files_of_one_partition_are_read_by_many_tasks(spark):
    head = F.concat(F.lit("---\nname: Unit "), F.col("id").cast("string"), F.lit("\n---\n")).cast("binary")
    files = spark.range(0, 40, 1, 1).select(F.concat(F.lit("outline/units/"), F.col("id").cast("string"), F.lit(".md")).alias("relpath"), F.lit("unit").alias("role"), head.alias("content"))
    found = ingest.records(files, "en").select("name", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["name"] for r in found) == sorted(f"Unit {i}" for i in range(40)) and len({r["task"] for r in found}) > 2


def test_present_keeps_the_rows_given(spark):
    g = spark.createDataFrame([("a", "p", "x", "iri", None, None), ("a", "q", "y", "iri", None, None), ("b", "p", "x", "iri", None, None)], TRIPLE)
    asked = spark.createDataFrame([("a",), ("a",), ("c",), ("base/timeline",), (None,)], "uri string")
    assert sorted(r.uri for r in facts.present(g, asked, "base/").collect()) == ["a", "a", "base/timeline"]
