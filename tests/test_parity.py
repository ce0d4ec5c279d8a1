"""Parity of names: both fed and deferred, or neither."""

from pyspark.sql import functions as F

from lorespark.operators import facts


def test_names_in_many_rows_are_counted_once(spark):
    every = spark.range(4000).select(F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("name"))
    said = lambda *names: every.where(F.coalesce("name", F.lit("none")).isin(*names))
    other = spark.createDataFrame([("new",)], "name string")
    got = facts.parity(every, said("1", "none").union(other), said("none", "2").union(other))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("3", "neither"), ("4", "neither"), ("new", "both"), (None, "both")], key=str)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Join" not in plan  # which would bring all rows of a name into one task
